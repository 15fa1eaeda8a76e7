import numpy as np
import pytest

from veilspark.llm import mixing

DIMENSIONS = ("source", "lang", "topic")


def raked(rows, wanted):
    """rows: (source, lang, topic, tokens) -> weights, by plain loops; wanted: dimension -> value -> tokens."""
    w = np.array([float(r[3]) for r in rows])
    for _ in range(200):
        for k, d in enumerate(DIMENSIONS):
            for v, goal in wanted[d].items():
                at = np.array([r[k] == v for r in rows])
                if w[at].sum():
                    w[at] *= goal / w[at].sum()
    return w


def test_against_plain_loops(spark, small):
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source) for r in small], "doc_id bigint, text string, lang string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(small)
    assert {r.doc_id: r.n_tokens for r in found} == {r.doc_id: len([w for w in r.text.replace("\n", " ").replace("\t", " ").split(" ") if w]) for r in small}
    rows = [(r.source, r.lang, r.topic, r.n_tokens) for r in found]
    total = sum(r[3] for r in rows)
    wanted = {}
    for k, d in enumerate(DIMENSIONS):
        own = {}
        for r in rows:
            own[r[k]] = own.get(r[k], 0) + r[3]
        shares = {v: n ** mixing.TEMPER[d] for v, n in own.items()}
        wanted[d] = {v: total * x / sum(shares.values()) for v, x in shares.items()}
    weights = raked(rows, wanted)
    assert np.allclose([r.weight for r in found], weights, rtol=0.01)
    expected = sum(r.probability * r.n_tokens for r in found)
    assert expected == pytest.approx(mixing.SHARE * total, rel=1e-6)
    rate = {r.doc_id: r.weight / r.n_tokens for r in found if r.n_tokens}
    scale = [r.probability / rate[r.doc_id] for r in found if r.n_tokens and r.probability < 1]
    assert max(scale) == pytest.approx(min(scale), rel=1e-6)
    kept = {r.doc_id for r in mixing.sample(docs).collect()}
    assert kept == {r.doc_id for r in found if r.sampled}


def test_given_targets_are_met(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en" if i % 3 else "de", f"s{i % 2}") for i in range(6000)], "doc_id bigint, text string, lang string, source string")
    found = mixing.mix(docs, wanted={"source": {"s0": 0.2, "s1": 0.8}, "lang": {"en": 0.5, "de": 0.5}}, share=0.3).toPandas()
    kept = found[found.sampled]
    assert abs((kept.source == "s1").mean() - 0.8) < 0.04 and abs((kept.lang == "de").mean() - 0.5) < 0.04
    assert abs(len(kept) / len(found) - 0.3) < 0.03


def test_odd_rows(odd, odd_rows, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.probability <= 1 for r in found)
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_bounded_marginals_are_as_near_as_own_tokens_allow(spark, small, share):
    """Values short of tokens are kept whole, the others keep their proportions, in every marginal."""
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source) for r in small], "doc_id bigint, text string, lang string, source string")
    mixed = mixing.mix(docs, share=share, bounded=True).cache()
    rows = mixed.collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.probability * r.n_tokens for r in rows) == pytest.approx(share * total, rel=1e-6)
    for d in DIMENSIONS:
        own, expected = {}, {}
        for r in rows:
            own[r[d]] = own.get(r[d], 0) + r.n_tokens
            expected[r[d]] = expected.get(r[d], 0) + r.n_tokens * r.probability
        goal = {v: n ** mixing.TEMPER[d] for v, n in own.items()}
        low, high = 0.0, float(total)
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(min(own[v], middle * goal[v]) for v in own) < share * total else (low, middle)
        nearest = {v: min(own[v], high * goal[v]) for v in own}
        assert max(abs(expected[v] - nearest[v]) for v in own) < 0.002 * share * total, d
    told = {(r.dimension, r.value): r for r in mixing.marginals(mixed).collect()}
    assert told["lang", "es"].expected == pytest.approx(sum(r.n_tokens * r.probability for r in rows if r.lang == "es") / (share * total), rel=1e-6)
    assert told["lang", "es"].own < told["lang", "es"].wanted


def test_bounded_odd_rows(odd, odd_rows, empty):
    found = mixing.mix(odd, bounded=True).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.probability <= 1 for r in found)
    assert mixing.mix(empty, bounded=True).count() == 0 and mixing.sample(empty, bounded=True).count() == 0


def test_topics_by_seed_words(spark):
    rows = [(1, "The CAT sat; the dog ran", "en", "s"), (2, "stocks and bonds, cat", "en", "s"), (3, "nothing here", "en", "s"), (4, None, "en", "s"), (5, "dog bonds", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    topic = mixing.seeded_topic(mixing.F.coalesce("text", mixing.F.lit("")), {"pets": ["cat", "dog"], "money": ["stocks", "bonds", "Bonds"]})
    assert {r.doc_id: r.topic for r in mixing.mix(docs, topic=topic).collect()} == {1: "pets", 2: "money", 3: "short", 4: "empty", 5: "money"}


def test_columns_with_the_operators_names_stay(spark):
    rows = [(i, "a b c " * (i % 5), "en", f"s{i % 3}", 9.0, "x", i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _u double, _source string, `row` bigint")
    kept = mixing.sample(docs).collect()
    assert kept and {tuple(r) for r in kept} <= {tuple(r) for r in docs.collect()}
