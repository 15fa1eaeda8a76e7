"""Redaction of text: spans become tokens or blocks; reversal by the token map; label geometry; sanitizing summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import MARK

BLOCK = "█"


def redacted(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, token or null) replaced: a token in brackets, a block for each character else. Spans inside or across earlier ones are passed over."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["token"].alias("token"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["last"]
        label = F.coalesce(F.concat(F.lit("["), s["token"], F.lit("]")), F.repeat(F.lit(BLOCK), end - s["start"]))
        plain = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(end.alias("at"), F.concat(acc["out"], plain, label).alias("out"))).otherwise(acc)

    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


TOKEN = r"\[[A-Z_]+_\d+\]"


def detokenized(text: Column, token_to_value: Column) -> Column:
    """Tokens in brackets turned back into their values, in one pass: a value that looks like a token stays as it is."""
    parts = F.split(F.regexp_replace(F.translate(text, MARK, " "), TOKEN, f"{MARK}$0{MARK}"), MARK, -1)
    bare = lambda x: F.regexp_replace(x, r"^\[|\]$", "")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(token_to_value, bare(x)), x)).otherwise(x)), "")


def redact(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the redacted text of documents; spans: key, start, end, token (null: a block)."""
    grouped = spans.groupBy(key).agg(F.collect_list(F.struct("start", "end", "token")).alias("spans"))
    return docs.select(key, text).join(grouped, key, "left").select(key, F.when(F.col("spans").isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col("spans"))).alias("redacted"))


# Widths of Helvetica's glyphs that tokens are made of, in thousandths of the font size.
GLYPHS = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611), strict=True)) | dict.fromkeys("0123456789_", 556) | dict.fromkeys("[]", 278)


def text_width(text: Column) -> Column:
    """The width of a token at font size 1; other signs count as digits."""
    widths = F.create_map(*[F.lit(x) for pair in GLYPHS.items() for x in pair])
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda n, c: n + F.coalesce(F.try_element_at(widths, c), F.lit(556))) / 1000


def label_geometry(width: Column, height: Column, rotation: Column, token: Column) -> tuple[Column, Column]:
    """(font size, descent) of a token's label in a box: by the line's height, and smaller by halves until the token fits its length.

    At a rotation of 90 or 270 the line runs along the box's height.
    """
    tall = F.pmod(rotation, F.lit(360)).isin(90, 270)
    line, length = F.when(tall, width).otherwise(height), F.when(tall, height).otherwise(width)
    size = F.greatest(F.lit(3.0), F.least(F.lit(10.0), line * 0.85))
    fits = F.greatest(F.lit(3.0), length / F.greatest(text_width(token), F.lit(1e-9)))
    return size - F.greatest(F.lit(0), F.ceil((size - fits) / 0.5)) * 0.5, F.greatest(F.lit(0.5), line * 0.15)


def label_anchor(box: list[Column], rotation: Column, descent: Column) -> tuple[Column, Column]:
    """Where a label begins, by the line's and the page's rotation together: half a point inside the box's edge."""
    left, top, right, bottom = box
    turn = F.pmod(rotation, F.lit(360))
    x = F.when(turn == 90, right - descent).when(turn == 180, right - 0.5).when(turn == 270, left + descent).otherwise(left + 0.5)
    y = F.when(turn == 90, bottom - 0.5).when(turn == 180, top + descent).when(turn == 270, top + 0.5).otherwise(bottom - descent)
    return x, y


def chosen_boxes(captured: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """Boxes to redact: an entity with captured boxes uses only these, on all pages; the others use the matcher's."""
    rest = matched.join(captured.select(*key).distinct(), key, "left_anti")
    return captured.withColumn("origin", F.lit("captured")).unionByName(rest.withColumn("origin", F.lit("matched")))


def safe_name(client: Column, stem: Column, existing: Column) -> Column:
    return F.coalesce(existing, F.concat(F.lit("pii_safe_"), F.substring(F.sha2(F.concat_ws("/", client, stem), 256), 1, 12), F.lit(".pdf")))


def sanitize_summary(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and what sanitizing strips from each document: objects(doc_id, kind, n); documents without any report none."""
    has = lambda kind: F.coalesce(F.bool_or(F.when(F.col("kind") == kind, F.col("n") > 0)), F.lit(False))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    rows = documents.select("doc_id").join(objects, "doc_id", "left").groupBy("doc_id")
    return rows.agg(has("info").alias("info_stripped"), has("xmp").alias("xmp_stripped"), has("openaction").alias("openaction_stripped"), has("aa").alias("aa_stripped"), count("js").alias("javascript_removed"), count("embedded").alias("embedded_removed"), count("annot").alias("annots_removed"))
