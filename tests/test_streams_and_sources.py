import json

from pyspark.sql import functions as F

from veilspark.functions import patterns, text
from veilspark.operators import crm, detect, redact
from veilspark.plans.cases import TEXTS, table
from veilspark.sources import layout
from veilspark.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    ingest.detect_stream(ingest.stream_documents(spark, f"{tmp_path}/in", "doc_id bigint, text string", files_a_batch=1), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, detect.detect(docs, patterns.ALL).select(*found.columns).collect()))


def test_streamed_reviews_give_the_union(spark, tmp_path):
    events = crm.review_events(table(spark, "recs"), table(spark, "manual"), table(spark, "decisions"))
    events.write.parquet(f"{tmp_path}/in")
    ingest.merge_reviews_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert sorted(map(str, ingest.literals(spark, f"{tmp_path}/t").collect())) == sorted(map(str, crm.union_literals(events).collect()))


def test_layout_files(spark, tmp_path):
    lines = layout.lines(spark.read.parquet(f"{SMALL}/documents.parquet").limit(3))
    for r in layout.layout_json(lines, layout.words(lines)).collect():
        (tmp_path / f"{r.doc_id}.json").write_text(r.layout)
    (tmp_path / "broken.json").write_text("{nope")
    (tmp_path / "empty.json").write_text(json.dumps({"schema_version": "v4.10", "pages": {}}))
    assert layout.read_layout_json(spark, str(tmp_path)).count() == lines.count()


def test_registered_recognizers(spark):
    patterns.register_recognizer("case_number", "CASE", r"\bCASE-\d+\b", 0.9)
    docs = spark.createDataFrame([(1, "see CASE-77 now")], "doc_id bigint, text string")
    found = detect.detect(docs, patterns.registered()).collect()
    assert [(r.value, r.category) for r in found] == [("CASE-77", "CASE")]


def test_offsets_and_overlapping_spans(spark):
    row = spark.createDataFrame([("é12 ab 345",)], "t string")
    assert [tuple(x) for x in row.select(text.scan(F.col("t"), r"\d+")).first()[0]] == [(1, 3, "12"), (7, 10, "345")]
    spans = "array(named_struct('start', 0, 'end', 4, 'token', 'A_1'), named_struct('start', 2, 'end', 6, 'token', 'B_1'), named_struct('start', 6, 'end', 8, 'token', cast(null as string)))"
    found = spark.createDataFrame([("abcdefghij",)], "t string").select(redact.redacted(F.col("t"), F.expr(spans))).first()[0]
    assert found == "[A_1]ef██ij"


def test_status_changes(spark):
    rows = spark.createDataFrame([("c", 1, 1, "a", None), ("c", 1, 2, "a", None), ("c", 1, 3, "b", None), ("c", 2, 1, "x", "m")], "client_id string, doc_id int, at int, status string, message string")
    assert [(r.doc_id, r.at) for r in ingest.status_changes(rows).collect()] == [(1, 3)]


def test_new_files_are_registered_once(spark, tmp_path):
    for client, name in (("C1", "a.pdf"), ("C1", "b.pdf"), ("C2", "a.pdf"), ("C2", "notes.txt")):
        (tmp_path / "in" / client).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / client / name).write_bytes(b"x" * 5)
    spark.createDataFrame([("C1", "a")], "client_id string, stem string").write.parquet(f"{tmp_path}/reviews")
    run = lambda: ingest.register_files(ingest.stream_files(spark, f"{tmp_path}/in"), f"{tmp_path}/reviews", f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    run()
    (tmp_path / "in" / "C2" / "late.pdf").write_bytes(b"yy")
    run()
    assert sorted((r.client_id, r.stem, r.length) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("C1", "b", 5), ("C2", "a", 5), ("C2", "late", 2)]
