"""Results worked out by hand, so that an error shared by code and SQL twin would be seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import patterns
from veilspark.operators import detect, redact, tokens
from veilspark.plans.queries import QUERIES


def test_prefixes_are_those_of_the_format():
    """Fixed values."""
    assert tokens.PREFIXES == {"PERSON": "NAME", "ACCOUNT_NUMBER": "ACCOUNT", "PHONE_NUMBER": "PHONE", "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "ADDRESS": "ADDRESS", "DATE_OF_BIRTH": "DOB", "DATE_TIME": "DATE", "CREDIT_CARD": "CARD", "IBAN_CODE": "IBAN", "URL": "URL", "SG_NRIC": "NRIC", "SG_UEN": "UEN", "SG_PHONE": "PHONE", "ISIN": "ISIN"}


def test_given_tokens_lift_the_count(spark):
    found = {(r.doc, r.ord): r.token for r in QUERIES["token_explicit"](spark, "").collect()}
    assert [found[1, k] for k in range(1, 11)] == ["ACCOUNT_1", "NAME_2", "ACCOUNT_1", "NAME_3", "NAME_4", "ACCOUNT_3", "ACCOUNT_4", "PHONE_1", "PHONE_2", "NAME_2"]


def test_votes_are_asked_when_a_model_votes(spark):
    found = {(r.doc_id, r.entity): (r.vote_count, r.consensus_passed) for r in QUERIES["ner_vote_accumulate"](spark, "").collect()}
    assert found[3, "Cyd"] == (2, False)  # the pattern came after the only model
    assert found[3, "Dee"] == (2, True) and found[1, "Ann"] == (2, True) and found[1, "Bob"] == (1, False) and found[1, "123456-7890"] == (1, True)


def test_phone_pieces_are_held_against_their_neighbours(spark):
    assert {r.phone: r.disjoint for r in QUERIES["det_phone_disjoint"](spark, "").collect()}[6]


def test_labels_shrink_until_they_fit(spark):
    row = spark.sql("SELECT 20.0D AS w, 10.0D AS h, '[NAME_1]' AS t")
    size, descent = redact.label_geometry(F.col("w"), F.col("h"), F.lit(0), F.col("t"))
    # 8.5 at first; the token is 4.29 wide at size 1: 8.5 - 8 * 0.5 = 4.5 fits into 20
    wide = (278 + 722 + 667 + 833 + 667 + 556 + 556 + 278) / 1000
    assert row.select(size.alias("s"), descent.alias("d")).first() == (4.0 if 4.5 * wide > 20 else 4.5, 1.5)
    turned, _ = redact.label_geometry(F.col("w"), F.col("h"), F.lit(90), F.col("t"))
    assert row.select(turned.cast("double").alias("s")).first().s == 3.0  # 10 high, 10 points of room: 2.33 would fit


def test_restored_values_are_not_replaced_again(spark):
    row = spark.sql("SELECT '[NAME_1] and [NAME_2], [NAME_3]' AS t, map('NAME_1', '[NAME_2]', 'NAME_2', 'Bob') AS m")
    assert row.select(redact.detokenized(F.col("t"), F.col("m")).alias("x")).first().x == "[NAME_2] and Bob, [NAME_3]"


def test_own_recognizers_see_every_text(spark):
    own = patterns.Recognizer("codename", "OTHER", 0.9, r"\bFalcon\b")
    docs = spark.createDataFrame([(1, "Project Falcon is secret"), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    assert [(r.start, r.value) for r in detect.scan_one(docs, own).collect()] == [(8, "Falcon")]
    assert [r.value for r in detect.detect(docs, [own, *patterns.ALL]).collect()] == ["Falcon"]


def test_declared_needs_leave_out_no_match(spark):
    """Every recognizer with and without what it declares to need, on the cases and the smallest documents."""
    from dataclasses import replace

    from veilspark.plans.queries import corpus

    docs = corpus(spark, "/root/testdata/sf0.001")
    for r in patterns.ALL:
        with_needs, without = (sorted(map(tuple, detect.scan_one(docs, x).collect())) for x in (r, replace(r, needs=None)))
        assert with_needs == without, r.name
