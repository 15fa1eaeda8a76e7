import hashlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup as x
from veilspark.llm.common import Scratch


def wanted(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((k for k in ids if k is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted((tuple(r) for r in x.exact_duplicates(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("bits,digest_bytes,capacity", [(64, 32, 65536), (64, 32, 4), (3, 32, 4), (3, 1, 4)])
def test_whole_table(spark, small, bits, digest_bytes, capacity):
    """Few bits of hash make texts collide (chains); a short digest leaves only their bytes to tell them apart."""
    rows = [(r.doc_id, r.text) for r in small]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = lambda c: F.shiftleft(F.xxhash64(c), 64 - bits) if bits < 64 else F.xxhash64(c)
    short = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, digest_bytes)
    assert found(docs, hash_of=weak, digest_of=short, capacity=capacity, max_depth=8) == wanted(rows)


def test_odd_rows(odd, odd_rows, empty):
    assert found(odd) == wanted([r[:2] for r in odd_rows])
    kept = x.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "4", "5", "7", "8", "9", "10", "11", "12", "None"])
    assert found(empty) == [] and x.drop_duplicates(empty).count() == 0


def test_directory_splits_overfull_buckets(spark):
    entries = spark.createDataFrame([(p,) for p in [0] * 5 + [1] * 5 + [4] * 3 + [200] * 2], "prefix int")
    rows = {r.prefix: r for r in x.directory(entries, 6, 8).collect()}
    assert rows[200].depth == 1 and rows[0].depth == 8 and rows[1].depth == 8 and rows[4].depth == 6
    assert rows[0].bucket != rows[1].bucket


def test_index_files_hold_each_text_once(spark, small):
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in small], "doc_id bigint, text string")
    index = x.build_index(docs, Scratch(spark, "t"), capacity=16)
    assert index.count() == len({r.text for r in small})
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 16


def test_hot_texts_are_folded_and_met_by_bytes(spark, monkeypatch):
    """A third of all rows is one text; with few bits of hash, a hot hash holds other texts too; both ways of meeting them."""
    monkeypatch.setattr(x, "HOT", 20)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 90}" if i % 3 == 1 else None if i % 7 == 0 else f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = lambda c: F.shiftleft(F.xxhash64(c), 60)
    assert found(docs) == wanted(rows) and found(docs, hash_of=weak, capacity=4) == wanted(rows)
    kept = {max(i for i, t in rows if (t or "") == text) for text in {t or "" for _, t in rows}}
    for options in ({}, {"hash_of": weak, "capacity": 4}):
        assert sorted(r.doc_id for r in x.drop_duplicates(docs, **options).collect()) == sorted(kept)


def test_directory_doubles_as_long_as_it_takes(spark):
    """Hashes that differ in their last bits alone: the survey goes down to all 64."""
    rows = [(i, f"t{i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    narrow = lambda c: F.pmod(F.xxhash64(c), F.lit(16))
    index = x.build_index(docs, Scratch(spark, "t"), capacity=4, hash_of=narrow)
    buckets = index.groupBy("bucket").agg(F.count_distinct("hash").alias("hashes"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in buckets) == 64 and all(r.n <= 4 or r.hashes == 1 for r in buckets) and len(buckets) > 8
    assert index.groupBy("hash").agg(F.max("chain").alias("m"), F.count("*").alias("n")).where("m != n - 1").isEmpty()


def test_columns_with_the_operators_names_stay(spark):
    rows = [(1, "a", "x", 5, "p"), (2, "a", "y", 6, "q"), (3, None, "z", None, "r"), (4, "", "z", None, "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _s string, hash bigint, `row` string")
    assert sorted(tuple(r) for r in x.drop_duplicates(docs).collect()) == [rows[1], rows[3]]
