import corpus_pipeline as p
from test_near_dedup import wanted as components
from test_packing import wanted as packed

from veilspark.llm import mixing, toxicity
from veilspark.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"


def test_each_stage_against_plain_code(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    work = Scratch(spark, "t")
    results = []
    for k, (_, stage) in enumerate(p.STAGES):
        docs = work.put(stage(spark, docs, SMALL), f"{k}")
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = [{r.doc_id: r.text for r in d.collect()} for d in results[:-1]]

    words, weights, base, counts = toxicity.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scorer = toxicity.Scorer(words, weights, base, counts)
    assert kept[0] == {i: t for i, t in start.items() if scorer.score(t) < toxicity.THRESHOLD}
    assert set(kept[1]) == {max(i for i, t in kept[0].items() if t == text) for text in kept[0].values()}
    label = components(list(kept[1].items()), 5)
    assert set(kept[2]) == {i for i, (_, top) in label.items() if i == top}
    assert set(kept[3]) == {r.doc_id for r in mixing.mix(results[2], share=p.SHARE).collect() if r.sampled}
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in results[4].collect()]
    assert sorted(found) == sorted(packed(list(kept[3].items()), 4096).elements())


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(p.run(spark, SMALL).columns)


def test_odd_rows_and_names_through_all_stages(spark, odd, odd_rows):
    """Nulls, empty and very long texts, repeated rows, and columns with names that the operators use inside."""
    inner = ("row", "hash", "text_sha256", "_u", "_source", "_gone", "_s", "node", "bucket")
    docs = odd.select("*", *(mixing.F.lit(k).alias(c) for k, c in enumerate(inner)))
    columns, work = docs.columns, Scratch(spark, "t")
    kept = []
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        docs = work.put(stage(spark, docs, SMALL), f"{k}")
        assert docs.columns == columns
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
        assert all(r[inner[0]] == 0 and r[inner[-1]] == len(inner) - 1 for r in docs.collect())
    rows = [(r[0], r[1]) for r in odd_rows]
    assert sorted(kept[0], key=str) == sorted(rows, key=str)  # nothing odd is toxic
    texts = {t or "" for _, t in rows}
    assert sorted((t or "") for _, t in kept[1]) == sorted(texts)
    for text in texts:
        ids = [i for i, t in rows if (t or "") == text]
        assert [i for i, t in kept[1] if (t or "") == text] == [max((i for i in ids if i is not None), default=None)]
    label = components([(i, t) for i, t in kept[1] if i is not None], 5)
    assert {i for i, _ in kept[2] if i is not None} == {i for i, (_, top) in label.items() if i == top} and len([i for i, _ in kept[2] if i is None]) == 1
    assert set(kept[3]) <= set(kept[2])
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in p.pack_sequences(spark, docs, SMALL).collect()]
    assert sorted(found, key=str) == sorted(packed(kept[3], 4096).elements(), key=str)


def test_empty_table_through_all_stages(spark, empty):
    docs, work = empty, Scratch(spark, "t")
    for k, (_, stage) in enumerate(p.STAGES):
        docs = work.put(stage(spark, docs, SMALL), f"{k}")
        assert docs.count() == 0
