"""Detection: scans, suppression of contained spans, votes of named-entity models, aliases, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import THRESHOLD, Recognizer
from veilspark.functions.text import normal_category, scan

SCORED = "array<struct<start:int,end:int,value:string,type:string,name:string,score:double>>"


def matches(text: Column, recognizer: Recognizer) -> Column:
    """Scored spans of one recognizer."""
    found = scan(text, recognizer.pattern)
    if recognizer.check:
        found = F.filter(found, lambda x: checked(x["value"], recognizer.check))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(recognizer.entity_type).alias("type"), F.lit(recognizer.name).alias("name"), F.lit(recognizer.score).alias("score")))


def checked(value: Column, check: str) -> Column:
    """The recognizer's condition: Luhn's sum for cards, the remainder 97 for IBANs."""
    if check == "luhn":
        return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))
    compact = F.regexp_replace(value, " ", "")
    letters = F.split(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)), "")
    step = lambda s, c: F.when(c == "", s).when(c.rlike("[A-Z]"), (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)
    return F.aggregate(letters, F.lit(0).cast("int"), lambda s, c: step(s, c).cast("int")) == 1


def needed(text: Column, recognizer: Recognizer) -> Column:
    """Whether a text can hold a match at all."""
    if recognizer.needs is None:
        return text.isNotNull()
    return text.contains(recognizer.needs) if recognizer.needs == "@" else text.rlike(recognizer.needs)


def scan_one(docs: DataFrame, recognizer: Recognizer, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, value of a recognizer's matches. Texts that lack what it declares to need are skipped unread by the pattern."""
    return docs.where(needed(F.col(text), recognizer)).select(key, F.explode(matches(F.col(text), recognizer)).alias("m")).select(key, "m.start", "m.end", "m.value")


def scan_all(docs: DataFrame, recognizers: list[Recognizer], *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key and one array `spans` of all matches at or above the threshold, in one pass over the text and without a shuffle."""
    used = [r for r in recognizers if r.score >= threshold]
    if not used:
        return docs.select(key, F.array().cast(SCORED).alias("spans")).limit(0)
    any_digit = F.col(text).rlike("[0-9@]") if all(r.needs for r in used) else F.lit(True)
    found = [F.when(needed(F.col(text), r), matches(F.col(text), r)).otherwise(F.array()).cast(SCORED) for r in used]
    return docs.where(any_digit).select(key, F.concat(*found).alias("spans")).where(F.size("spans") > 0)


def one_of_each(spans: Column) -> Column:
    """Within one type, spans inside a longer one of at least their score go; of equal ones the first in (score, name) order stays."""
    inside = lambda r, k: (k["type"] == r["type"]) & (k["start"] <= r["start"]) & (k["end"] >= r["end"]) & (k["score"] >= r["score"])
    longer = lambda r, k: k["end"] - k["start"] > r["end"] - r["start"]
    better = lambda r, k: (k["end"] - k["start"] == r["end"] - r["start"]) & ((k["score"] > r["score"]) | ((k["score"] == r["score"]) & (k["name"] < r["name"])))
    return F.filter(spans, lambda r: ~F.exists(spans, lambda k: inside(r, k) & (longer(r, k) | better(r, k))))


def suppressed(spans: Column) -> Column:
    """Spans by falling score, falling length and start; one that lies in a kept span of another type and at least its score goes."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct((-x["score"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("c"), x["name"].alias("d"), x.alias("x"))))
    hides = lambda r, k: (k["start"] <= r["start"]) & (k["end"] >= r["end"]) & (k["type"] != r["type"]) & (k["score"] >= r["score"])
    keep = lambda kept, r: F.when(F.exists(kept, lambda k: hides(r["x"], k)), kept).otherwise(F.concat(kept, F.array(r["x"])))
    return F.aggregate(order, F.array().cast(SCORED), keep)


def detect(docs: DataFrame, recognizers: list[Recognizer], *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, start, end, value, type, category, name, score after suppression; ISINs only suppress and are dropped last."""
    found = scan_all(docs, recognizers, key=key, text=text, threshold=threshold).withColumn("spans", one_of_each(F.col("spans")))
    rows = found.withColumn("spans", suppressed(F.col("spans"))).select(key, F.explode("spans").alias("m")).where("m.type != 'ISIN'")
    return rows.select(key, "m.start", "m.end", "m.value", "m.type", normal_category(F.col("m.type")).alias("category"), "m.name", "m.score")


def disjoint_phones(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key and whether a phone's boxes lie apart: neighbours in a row with a gap wider than both of them."""
    order = Window.partitionBy(*key).orderBy(F.bround("top"), "left")
    rows = pieces.withColumn("width", F.greatest(F.col("right") - F.col("left"), F.lit(0.1)))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("top", "left", "width")})
    apart = (F.abs(F.col("next_top") - F.col("top")) <= 2) & (F.col("next_left") - F.col("right") > F.greatest("width", "next_width"))
    return rows.groupBy(*key).agg(F.coalesce(F.bool_or(apart), F.lit(False)).alias("disjoint"))


def consensus(votes: DataFrame, models: int) -> DataFrame:
    """doc_id, page, entity, models_voted, vote_count, consensus_passed; with no models one vote is enough."""
    least = max(1, min(2, models))
    found = votes.groupBy("doc_id", "page", "entity").agg(F.array_sort(F.collect_set("model")).alias("models_voted"))
    return found.withColumn("vote_count", F.size("models_voted")).withColumn("consensus_passed", F.col("vote_count") >= least)


def accumulate(sightings: DataFrame, models: int) -> DataFrame:
    """Votes of a document's pages together: sightings(doc_id, page, entity, category, voter).

    The category is the first sighting's; a pattern counts as a voter; consensus is asked only of entities that a model
    has voted for, and only when one does: on the last page with such a vote, with the voters known by then. A pattern
    that hits on a later page adds its vote, but consensus isn't asked anew.
    """
    least = max(1, min(2, models))
    last = F.max(F.when(F.col("voter") != "regex", F.col("page"))).over(Window.partitionBy("doc_id", "entity"))
    found = sightings.withColumn("asked", last).groupBy("doc_id", "entity").agg(
        F.min_by("category", F.struct("page", F.when(F.col("voter") == "regex", 0).otherwise(1), "category")).alias("category"),
        F.array_sort(F.collect_set("voter")).alias("models_voted"),
        F.count_distinct(F.when(F.col("page") <= F.col("asked"), F.col("voter"))).alias("voters_then"),
        F.first("asked").alias("asked"),
    )
    passed = F.when(F.col("asked").isNotNull(), F.col("voters_then") >= least).otherwise(True)
    return found.select("doc_id", "entity", "category", "models_voted", F.size("models_voted").alias("vote_count"), passed.alias("consensus_passed"))


def title_aliases(page_texts: DataFrame, persons: DataFrame) -> DataFrame:
    """doc_id, variant, alias_of: titles in front of a known person: the title as it stands there, one space, the person as known."""
    title = r"(?i)\b(?:Mr|Mrs|Mdm|Ms|Miss|Dr|Prof|Sir|Madam)\.?\s+"  # fixed value
    found = page_texts.select("doc_id", "text", F.explode(scan(F.col("text"), title)).alias("m"))
    pairs = found.join(persons.select("doc_id", "entity"), "doc_id")
    follows = F.expr("substring(text, m.end + 1, char_length(entity))")
    rows = pairs.where(F.lower(follows) == F.lower("entity"))
    return rows.select("doc_id", F.concat(F.regexp_replace("m.value", r"\s+$", ""), F.lit(" "), "entity").alias("variant"), F.col("entity").alias("alias_of")).distinct()


def initial_aliases(persons: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """doc_id, variant, alias_of: persons without the stops after their initials, unless that is a known entity already.

    Persons that are aliases themselves (aliases: doc_id, variant) have none of their own.
    """
    if aliases is not None:
        persons = persons.join(aliases.select("doc_id", F.col("variant").alias("entity")), ["doc_id", "entity"], "left_anti")
    rows = persons.select("doc_id", F.regexp_replace("entity", r"\b([A-Z])\.(?=\s|$)", "$1").alias("variant"), F.col("entity").alias("alias_of")).where("variant != alias_of")
    known = persons.select("doc_id", F.col("entity").alias("variant"))
    return rows.join(known, ["doc_id", "variant"], "left_anti")


def carried_over(page_texts: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, page, entity: later pages of a document that hold a value found on an earlier page, case and all."""
    first = entities.groupBy("doc_id", "entity").agg(F.min("page").alias("first_page"))
    return page_texts.join(first, "doc_id").where("page > first_page and contains(text, entity)").select("doc_id", "page", "entity")


def ranked(recommendations: DataFrame) -> DataFrame:
    """Adds id 'e{i}' by falling votes and lower-cased entity, in each document."""
    order = Window.partitionBy("doc_id").orderBy(F.col("vote_count").desc(), F.lower("entity"), "entity")
    return recommendations.withColumn("id", F.concat(F.lit("e"), (F.row_number().over(order) - 1).cast("string")))


def dedupe_occurrences(occurrences: DataFrame, key: list[str]) -> DataFrame:
    """Of occurrences whose boxes are equal to one decimal, the first."""
    box = [F.bround(F.col(c).cast("double"), 1) for c in ("left", "top", "right", "bottom")]
    first = Window.partitionBy(*key, "page", *box).orderBy("ord")
    return occurrences.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
