"""Decisions, tokens and maps: who is approved, which token each value gets, and what leaves with the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The prefix of a category's tokens.
PREFIXES = {"PERSON": "NAME", "ACCOUNT_NUMBER": "ACCOUNT", "ADDRESS": "ADDRESS", "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "SG_PHONE": "PHONE", "SG_NRIC": "NRIC", "SG_UEN": "UEN", "CREDIT_CARD": "CARD", "IBAN_CODE": "IBAN", "DATE_OF_BIRTH": "DOB", "DATE_TIME": "DATE", "URL": "URL", "ISIN": "ISIN"}
OTHER = "OTHER"


def prefix(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair]), category), F.lit(OTHER))


def tokenize_on(tokenize: Column, category: Column) -> Column:
    return F.coalesce(tokenize, category == "ACCOUNT_NUMBER")


def auto_rejected(category: Column, passed: Column, rejected: Column) -> Column:
    """A person below consensus, unless a decision says explicitly that it isn't rejected."""
    return (category == "PERSON") & (~F.coalesce(passed, F.lit(True))) & ~rejected.eqNullSafe(F.lit(False))


def resolve(decisions: DataFrame, manual: DataFrame, recs: DataFrame) -> DataFrame:
    """entity, category, tokenize, source of what is approved: by a decision, by hand, or as a recommendation.

    decisions: entity, category, tokenize, token, rejected; manual: entity, category, tokenize; recs: entity, category,
    consensus_passed. A decision that rejects (by its flag, or category REJECT) keeps its entity out of the
    recommendations, not of manual additions; nothing is approved with category REJECT or none. The category is the
    manual one's, where there is any. A label needs every decision and manual addition of the entity to ask for it;
    a recommendation takes the tokenize flag of a decision that itself approved nothing.
    """
    refused = F.coalesce("rejected", F.lit(False)) | F.col("category").eqNullSafe("REJECT")
    open_ = F.col("category").isNotNull() & (F.col("category") != "REJECT")
    label = tokenize_on(F.col("tokenize"), F.col("category"))
    a = decisions.where(~refused & open_).select("entity", "category", label.alias("tokenize"), F.lit("decision").alias("source"))
    b = manual.where(open_).groupBy("entity").agg(F.max("category").alias("category"), F.bool_and(label).alias("tokenize")).withColumn("source", F.lit("manual"))
    both = a.join(b.select("entity", F.col("category").alias("c"), F.col("tokenize").alias("t"), F.col("source").alias("s")), "entity", "full")
    both = both.select("entity", F.coalesce("c", "category").alias("category"), (F.coalesce("tokenize", F.lit(True)) & F.coalesce("t", F.lit(True))).alias("tokenize"), F.coalesce("source", "s").alias("source"))
    said = decisions.select("entity", "rejected", refused.alias("refused"), F.col("tokenize").alias("asked"))
    left = recs.where(open_).join(said, "entity", "left").where(~F.coalesce("refused", F.lit(False)) & ~auto_rejected(F.col("category"), F.col("consensus_passed"), F.col("rejected"))).join(both.select("entity"), "entity", "left_anti")
    c = left.select("entity", "category", tokenize_on(F.col("asked"), F.col("category")).alias("tokenize"), F.lit("rec").alias("source"))
    return both.unionByName(c)


NOWHERE = (999, 1e9, 1e9)  # fixed value: page, top and left of what occurs nowhere


def first_or_nowhere(entities: DataFrame, occurrences: DataFrame, key: list[str]) -> DataFrame:
    """first_occurrence of all entities; those without any sort after all others."""
    found = entities.join(first_occurrence(occurrences, key), key, "left")
    page, top, left = (F.coalesce(F.col(c).cast("double"), F.lit(float(x))).alias(c) for c, x in zip(("page", "top", "left"), NOWHERE, strict=True))
    return found.select(*key, page, top, left, F.coalesce("n_occ", F.lit(0).cast("bigint")).alias("n_occ"))


def first_occurrence(occurrences: DataFrame, key: list[str]) -> DataFrame:
    """page, top and left of each entity's first occurrence in reading order."""
    rows = occurrences.groupBy(*key).agg(F.min(F.struct("page", "top", "left")).alias("f"), F.count("*").alias("n_occ"), F.count_distinct("page").alias("n_pages"))
    return rows.select(*key, F.col("f.page").alias("page"), F.col("f.top").alias("top"), F.col("f.left").alias("left"), "n_occ", "n_pages")


def assign(values: DataFrame, scope: list[str], order: list[str], *, by: str = "prefix") -> DataFrame:
    """Adds token PREFIX_K: K counts the values of a scope and prefix (or category) in order. Numbers aren't shared between categories unless asked for."""
    rows = values.withColumn("prefix", prefix(F.col("category")))
    number = F.row_number().over(Window.partitionBy(*scope, by).orderBy(*order))
    return rows.withColumn("token", F.concat_ws("_", "prefix", number.cast("string")))


def with_explicit(values: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Tokens where some are given, in order: a given token is kept and lifts its category's count to its number, the others take the next number.

    After any value the count is the number of free values so far, or, counted on from a given number, that number and
    the free values since: the greatest of these. Categories of one prefix count together. A free value may get the
    number of a token that is given later; the two are aliases then.
    """
    so_far = Window.partitionBy(*scope, "prefix").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = values.withColumn("prefix", prefix(F.col("category"))).withColumn("given", F.regexp_replace("token", r"^\[|\]$", ""))
    rows = rows.withColumn("free", F.sum(F.col("given").isNull().cast("int")).over(so_far))
    lift = F.max(F.regexp_extract("given", r"^[A-Z_]+_(\d+)$", 1).try_cast("int") - F.col("free")).over(so_far)
    rows = rows.withColumn("number", F.col("free") + F.greatest(F.lit(0), F.coalesce(lift, F.lit(0))))
    return rows.select(*[c for c in values.columns if c != "token"], F.coalesce("given", F.concat_ws("_", "prefix", F.col("number").cast("string"))).alias("token"))


def token_conflicts(values: DataFrame, scope: list[str]) -> DataFrame:
    """Entities to which more than one token is given."""
    return values.groupBy(*scope, "entity").agg(F.count_distinct("token").alias("tokens")).where("tokens > 1")


def alias_groups(values: DataFrame, scope: list[str], order: str) -> DataFrame:
    """token, its canonical value (the first in order) and its values: a token that several share makes them aliases."""
    return values.groupBy(*scope, "token").agg(F.min_by("entity", F.struct(order, "entity")).alias("canonical"), F.array_sort(F.collect_set("entity")).alias("entities"))


def inherit(values: DataFrame, aliases: DataFrame, scope: list[str]) -> DataFrame:
    """Aliases (variant, alias_of) with the token of what they stand for."""
    return aliases.join(values.select(*scope, F.col("entity").alias("alias_of"), "token"), [*scope, "alias_of"]).select(*scope, F.col("variant").alias("entity"), "alias_of", "token")


def parse_token(token: Column) -> tuple[Column, Column]:
    return F.regexp_extract(token, r"^\[?([A-Z_]+)_(\d+)\]?$", 1), F.regexp_extract(token, r"^\[?([A-Z_]+)_(\d+)\]?$", 2).try_cast("int")


def next_free(tokens: DataFrame, scope: list[str]) -> DataFrame:
    """The least K of each scope and prefix that no token has."""
    name, number = parse_token(F.col("token"))
    used = tokens.select(*scope, name.alias("prefix"), number.alias("k")).where("k > 0").distinct()
    rank = F.row_number().over(Window.partitionBy(*scope, "prefix").orderBy("k"))
    rows = used.withColumn("r", rank)
    # numbers stand at their own rank as long as none is missing
    return rows.groupBy(*scope, "prefix").agg((F.count_if(F.col("k") == F.col("r")) + 1).alias("next_k"))


def maps(values: DataFrame, scope: list[str]) -> DataFrame:
    """token_to_value and value_to_token of tokenized values; redact-only values leave neither, nor a token of their own."""
    kept = values.where("tokenize")
    return kept.groupBy(*scope).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("token").alias("key"), F.col("entity").alias("value"))))).alias("token_to_value"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("entity").alias("key"), F.col("token").alias("value"))))).alias("value_to_token"),
    )


def box_list(occurrences: DataFrame, values: DataFrame, scope: list[str]) -> DataFrame:
    """One row for each box of a redacted value: its token in brackets, the value, box, partial and redact_only (no label)."""
    told = values.select(*scope, "entity", F.concat(F.lit("["), F.regexp_replace("token", r"^\[|\]$", ""), F.lit("]")).alias("token"), (~F.col("tokenize")).alias("redact_only"))
    return occurrences.join(told, [*scope, "entity"]).select(*scope, "token", F.col("entity").alias("value"), "page", "left", "top", "right", "bottom", "line_id", "partial", "redact_only")
