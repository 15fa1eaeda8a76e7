"""The literals of a client over its documents: union of reviews, carry-forward, deletes, diffs, merges, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_events(recs: DataFrame, manual: DataFrame, decisions: DataFrame) -> DataFrame:
    """What reviews say about entities, in order: (client_id, entity, stem, phase, category, tokenize, token, rejected).

    recs and manual: client_id, stem, entity, category, tokenize, token (recs also n_occ); decisions: with rejected. A
    decision counts only for an entity that its own review holds with at least one occurrence, or added by hand.
    """
    active = recs.where("n_occ > 0")
    cols = ["client_id", "stem", "entity", "category", "tokenize", "token"]
    held = active.select("client_id", "stem", "entity").unionByName(manual.select("client_id", "stem", "entity")).distinct()
    no = F.lit(None).cast("boolean")
    return (
        active.select(*cols, no.alias("rejected"), F.lit(0).alias("phase"))
        .unionByName(manual.select(*cols, no.alias("rejected"), F.lit(1).alias("phase")))
        .unionByName(decisions.select(*cols, "rejected").join(held, ["client_id", "stem", "entity"], "left_semi").withColumn("phase", F.lit(2)))
        .where("category is null or category != 'REJECT'")
    )


def union_literals(events: DataFrame) -> DataFrame:
    """One literal per client and entity, from events in order of (stem, phase).

    category: the last that isn't OTHER, or that a decision gives, or the first; tokenize: true if any says so (unsaid:
    the category is ACCOUNT_NUMBER); token: the last; rejected: true once a decision rejects it; first_seen: the first
    stem; without any category it is OTHER. Rejecting decisions say nothing else, and an entity that only they name is no literal.
    """
    said = events.withColumn("says", ~F.coalesce("rejected", F.lit(False)))
    at = F.struct("stem", "phase")
    telling = F.when(F.col("says") & F.col("category").isNotNull() & ((F.col("category") != "OTHER") | (F.col("phase") == 2)), at)
    on = F.coalesce("tokenize", F.col("category") == "ACCOUNT_NUMBER")
    rows = said.groupBy("client_id", "entity").agg(
        F.max_by("category", telling).alias("told"),
        F.min_by("category", F.when(F.col("says"), at)).alias("first"),
        F.bool_or(F.when(F.col("says"), on)).alias("tokenize"),
        F.max_by("token", F.when(F.col("says") & F.col("token").isNotNull(), at)).alias("token"),
        F.bool_or(~F.col("says")).alias("rejected"),
        F.min(F.when(F.col("says"), F.col("stem"))).alias("first_seen"),
    )
    return rows.where("first_seen is not null").select("client_id", "entity", F.coalesce("told", "first", F.lit("OTHER")).alias("category"), F.coalesce("tokenize", F.lit(False)).alias("tokenize"), "token", "rejected", "first_seen")


def carry_forward(union: DataFrame, prior: DataFrame, deleted: DataFrame) -> DataFrame:
    """The union and the prior literals that it lacks, without what was deleted."""
    gone = deleted.select("client_id", "entity")
    kept = prior.join(union.select("client_id", "entity"), ["client_id", "entity"], "left_anti")
    return union.unionByName(kept.select(*union.columns)).join(gone, ["client_id", "entity"], "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many entities of each client came and went."""
    a, b = (x.select("client_id", "entity", F.lit(True).alias(n)) for x, n in ((before, "was"), (after, "is")))
    both = a.join(b, ["client_id", "entity"], "full")
    return both.groupBy("client_id").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"))


def populate(literals: DataFrame, occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """Every literal of a client as a recommendation of each of its documents, with its number of occurrences there (0 too)."""
    order = Window.partitionBy("client_id").orderBy("ord")
    rows = literals.withColumn("id", F.concat(F.lit("crm_"), (F.row_number().over(order) - 1).cast("string"))).join(documents.select("client_id", "doc_id"), "client_id")
    counts = occurrences.groupBy("client_id", "doc_id", "entity").agg(F.count("*").alias("n_occ"), F.count_distinct("page").alias("n_pages"))
    rows = rows.join(counts, ["client_id", "doc_id", "entity"], "left")
    return rows.select("client_id", "doc_id", "id", "entity", "category", F.coalesce("tokenize", F.lit(False)).alias("tokenize"), F.coalesce("n_occ", F.lit(0)).cast("bigint").alias("n_occ"), F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), F.lit(1).alias("vote_count"), F.lit(True).alias("consensus_passed"))


def diff(recs: DataFrame, literals: DataFrame, decisions: DataFrame) -> DataFrame:
    """client_id, stem, entity, change: stale, new, changed or same, of a sibling's recommendations against the literals.

    Whether an entity is rejected says the sibling's decision; unsaid flags count as false, a literal without category as OTHER.
    """
    fields = ["category", "token", "tokenize", "rejected"]
    no, key = F.lit(False), ["client_id", "stem", "entity"]
    said = decisions.select(*key, F.col("rejected").alias("refused"))
    mine = recs.join(said, key, "left").select(*key, F.struct("category", "token", F.coalesce("tokenize", no).alias("tokenize"), F.coalesce("refused", no).alias("rejected")).alias("was"))
    now = F.struct(F.coalesce("category", F.lit("OTHER")).alias("category"), "token", F.coalesce("tokenize", no).alias("tokenize"), F.coalesce("rejected", no).alias("rejected"))
    theirs = literals.join(recs.select("client_id", "stem").distinct(), "client_id").select(*key, now.alias("now"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col("was")[f].eqNullSafe(F.col("now")[f])
    change = F.when(F.col("now").isNull(), "stale").when(F.col("was").isNull(), "new").when(same, "same").otherwise("changed")
    return mine.join(theirs, ["client_id", "stem", "entity"], "full").select("client_id", "stem", "entity", change.alias("change"))


def merge_back(user: DataFrame, before: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Occurrences (entity, page, line) after a save: the user's, and rebuilt ones that are new since before.

    What the user trimmed stays away; an entity that the user's side doesn't have comes back as rebuilt.
    """
    key = ["entity", "page", "line_id"]
    new = rebuilt.join(user.select("entity").distinct(), "entity", "left_semi").join(user.select(*key), key, "left_anti").join(before.select(*key), key, "left_anti")
    lost = rebuilt.join(user.select("entity").distinct(), "entity", "left_anti")
    return user.select(*key).unionByName(new.select(*key)).unionByName(lost.select(*key)).distinct()


def reconcile(manual: DataFrame, recs: DataFrame) -> DataFrame:
    """Manual additions that aren't recommendations."""
    return manual.join(recs.select("client_id", "stem", "entity").distinct(), ["client_id", "stem", "entity"], "left_anti")


def client_listing(documents: DataFrame, literals: DataFrame) -> DataFrame:
    """client_id with its numbers of documents and literals, every client of either table."""
    docs = documents.groupBy("client_id").agg(F.count("*").alias("pdf_count"))
    lits = literals.groupBy("client_id").agg(F.count("*").alias("literal_count"))
    return docs.join(lits, "client_id", "full").select("client_id", F.coalesce("pdf_count", F.lit(0)).alias("pdf_count"), F.coalesce("literal_count", F.lit(0)).alias("literal_count"))


def file_status(live: Column, tokenized: Column, persisted: Column, has_json: Column) -> Column:
    """analyzing or applying wins; then applied where the output exists; then what was persisted; then analyzed; else idle."""
    return F.when(live.isin("analyzing", "applying"), live).when(tokenized, "applied").when(persisted.isNotNull(), persisted).when(has_json, "analyzed").otherwise("idle")


def latched(status: Column, now: Column) -> Column:
    """A document that was applied stays so."""
    return F.when(status == "applied", status).otherwise(now)


def upsert_outputs(outputs: DataFrame) -> DataFrame:
    """Of each document's applied outputs, the last."""
    order = Window.partitionBy("client_id", "original_stem").orderBy(F.col("applied_at").desc(), F.col("safe_filename").desc())
    return outputs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def absorb(current: DataFrame, added: DataFrame) -> DataFrame:
    """Regions (entity, page, line_id) to add to an entity: those that it doesn't have."""
    return added.join(current.select("entity", "page", "line_id"), ["entity", "page", "line_id"], "left_anti")


def save(recs: DataFrame, manual: DataFrame, decisions: DataFrame, prior: DataFrame, deleted: DataFrame) -> DataFrame:
    """A client's literals after a save: union of its reviews, what is carried forward, without what was deleted."""
    return carry_forward(union_literals(review_events(recs, manual, decisions)), prior, deleted)


def apply_diff(recs: DataFrame, decisions: DataFrame, literals: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A client's siblings after their diff: (recommendations, decisions).

    Stale recommendations go, with their decisions; new literals come with their occurrences there (none is no hindrance);
    changed ones take the literal's category, flag and token, and their decision does too. Rows of siblings without any
    change stay as they are. recs: client_id, stem, entity, category, tokenize, token, n_occ; occurrences: client_id,
    stem, entity.
    """
    key, no = ["client_id", "stem", "entity"], F.lit(False)
    change = diff(recs.withColumn("rejected", F.lit(None).cast("boolean")), literals, decisions)
    told = literals.select("client_id", "entity", F.coalesce("category", F.lit("OTHER")).alias("l_category"), F.coalesce("tokenize", no).alias("l_tokenize"), F.col("token").alias("l_token"), F.when(F.coalesce("rejected", no), True).alias("l_rejected"))
    moved = change.join(told, ["client_id", "entity"], "left")
    counts = occurrences.groupBy(*key).agg(F.count("*").alias("found"))
    renewed = F.col("change").isin("new", "changed")
    pick = lambda ours, theirs: F.when(renewed, F.col(theirs)).otherwise(F.col(ours)).alias(ours)
    rows = moved.where("change != 'stale'").join(recs, key, "left").join(counts, key, "left")
    n_occ = F.when(F.col("change") == "new", F.coalesce("found", F.lit(0).cast("bigint"))).otherwise(F.col("n_occ").cast("bigint"))
    after = rows.select(*key, pick("category", "l_category"), pick("tokenize", "l_tokenize"), pick("token", "l_token"), n_occ.alias("n_occ"))
    said = decisions.select(*key, "category", "tokenize", "token", "rejected").join(moved, key, "full").where("change is null or change != 'stale'")
    said = said.where(renewed | F.col("category").isNotNull() | F.col("tokenize").isNotNull() | F.col("rejected").isNotNull())
    decided = said.select(*key, pick("category", "l_category"), pick("tokenize", "l_tokenize"), pick("token", "l_token"), pick("rejected", "l_rejected"))
    return after, decided


def reanalyzed(fresh: DataFrame, manual: DataFrame) -> DataFrame:
    """A document's review after a new analysis: its fresh recommendations, and manual additions kept; decisions start anew."""
    return fresh.withColumn("source", F.lit("rec")).unionByName(manual.withColumn("source", F.lit("manual")), allowMissingColumns=True)
