"""The two drivers: analysis of documents into recommendations, and tokenization of documents by what was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.patterns import Recognizer
from veilspark.operators import detect, match, redact, tokens
from veilspark.sources import layout
from veilspark.sources.tables import stored


def analyze(docs: DataFrame, recognizers: list[Recognizer], *, votes: DataFrame | None = None, models: int = 3, regex: bool = True) -> DataFrame:
    """doc_id, entity, category, vote_count, consensus_passed, n_occ, id: a document's recommendations, ranked.

    Patterns vote as 'regex', on every page that holds a value; votes(doc_id, page, entity, model) are those of
    named-entity models. Occurrences are counted by the matcher's exact way; phones whose pieces lie apart are dropped.
    """
    lines = layout.lines(docs)
    pages = stored(layout.page_text(lines).withColumn("page_key", F.struct("client_id", "doc_id", "page")))
    sightings = []
    if regex:
        found = detect.detect(pages, recognizers, key="page_key")
        sightings.append(found.select("page_key.doc_id", "page_key.page", F.trim("value").alias("entity"), "category", F.lit("regex").alias("voter")).distinct())
    if votes is not None:
        sightings.append(votes.select("doc_id", "page", "entity", F.lit("PERSON").alias("category"), F.col("model").alias("voter")))
    if not sightings:
        return docs.select("doc_id", F.lit("").alias("entity"), F.lit("").alias("category"), F.lit(0).alias("vote_count"), F.lit(True).alias("consensus_passed"), F.lit(0).cast("bigint").alias("n_occ"), F.lit("").alias("id")).limit(0)
    rows = sightings[0] if len(sightings) == 1 else sightings[0].unionByName(sightings[1])
    recs = stored(detect.accumulate(rows, models).drop("models_voted"))
    clients = docs.select("doc_id", F.col("source").alias("client_id")).distinct()
    literals = recs.join(clients, "doc_id").select("client_id", "entity").distinct()
    words = stored(match.flat_words(layout.words(lines)))
    hits = stored(match.exact(words, match.prepared(literals), lines))
    apart = detect.disjoint_phones(hits, ["doc_id", "page", "entity"]).where("disjoint")
    phones = recs.where("category = 'PHONE_NUMBER'").select("doc_id", "entity")
    kept = hits.join(apart.join(phones, ["doc_id", "entity"]).select("doc_id", "page", "entity"), ["doc_id", "page", "entity"], "left_anti")
    counted = kept.groupBy("doc_id", "entity").agg(F.count("*").alias("n_occ"))
    out = recs.join(counted, ["doc_id", "entity"], "left").withColumn("n_occ", F.coalesce("n_occ", F.lit(0).cast("bigint")))
    return detect.ranked(out)


def tokenize(docs: DataFrame, recognizers: list[Recognizer], decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id and redacted text, doc_id and entity with token): detected values, without those that decisions reject, as tokens
    where a decision (or the category) asks for a label, else as blocks. decisions: doc_id, entity, tokenize, rejected."""
    found = stored(detect.detect(docs.select("doc_id", "text"), recognizers))
    said = decisions.select("doc_id", F.col("entity").alias("value"), F.col("tokenize").alias("asked"), "rejected")
    open_ = found.join(said, ["doc_id", "value"], "left").where(~F.coalesce("rejected", F.lit(False)))
    first = open_.groupBy("doc_id", F.col("value").alias("entity")).agg(F.min(F.struct("start", "category", "asked")).alias("f"))
    values = first.select("doc_id", "entity", F.col("f.category").alias("category"), F.col("f.start").alias("start"), tokens.tokenize_on(F.col("f.asked"), F.col("f.category")).alias("tokenize"))
    given = stored(tokens.assign(values, ["doc_id"], ["start", "entity"], by="category"))
    spans = open_.select("doc_id", "start", "end", F.col("value").alias("entity")).join(given.select("doc_id", "entity", F.when(F.col("tokenize"), F.col("token")).alias("token")), ["doc_id", "entity"])
    return redact.redact(docs, spans.select("doc_id", "start", "end", "token")), given.select("doc_id", "entity", "category", "token", "tokenize")
