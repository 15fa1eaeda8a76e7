"""Pages that stay in one row give what the joins of lines, words and characters give, and shuffle nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.operators import spatial
from veilspark.plans.cases import table
from veilspark.plans.queries import QUERIES, box_chars
from veilspark.sources import layout

SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", "\n", "a", " é  ü\t\x0b\x0c\r b \n\n  ", "x" * 40 + "\n" + "y z " * 20, "\n".join(f"line {i} 𝒳 ü" for i in range(120)), "end same word"]


def docs(spark):
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, source string")


def plain(rows):
    return sorted(map(str, rows.collect()))


@pytest.mark.parametrize("name", ["document_rule_cuts", "layout_json_roundtrip"])
def test_documents_are_not_shuffled(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_cut_pages_is_cut_at_rules(spark):
    lines, rules = table(spark, "box_lines"), table(spark, "rules")
    wanted = spatial.cut_at_rules(lines, rules, box_chars(spark))
    group = lambda rows, name: rows.groupBy("page").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "page"])).alias(name))
    strips = box_chars(spark).select("page", F.col("char").alias("text"), "left", "top", "right", "bottom").where("text != ''")
    pages = group(lines, "lines").join(group(rules, "rules"), "page", "left").join(group(strips, "strips"), "page", "left")
    pages = pages.withColumn("rules", F.coalesce("rules", F.expr("array()"))).withColumn("strips", F.coalesce("strips", F.expr("array()")))
    kept = ["page", "line_id", "part", "content", *(F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom"))]
    assert plain(spatial.cut_pages(pages).select(*kept)) == plain(wanted.select(*kept))


def test_page_rows_are_the_lines(spark):
    found = layout.page_rows(docs(spark)).select("client_id", "doc_id", "page", F.inline("lines"))
    assert plain(found) == plain(layout.lines(docs(spark)).select(*found.columns))


def test_documents_layout_is_layout_json(spark, monkeypatch):
    lines = layout.lines(docs(spark))
    read = lambda rows: plain(rows.select("doc_id", F.from_json("layout", layout.LAYOUT).alias("v")))
    assert read(layout.documents_layout(docs(spark))) == read(layout.layout_json(lines, layout.words(lines)))


def test_texts_are_cut_a_few_at_once(monkeypatch):
    monkeypatch.setattr(layout, "MOST_BYTES", 5)
    texts = ["abc", "de", "f", "", "too long a text", "g"]
    assert [texts[a:b] for a, b in layout.few_at_once(texts)] == [["abc", "de"], ["f", ""], ["too long a text"], ["g"]]
