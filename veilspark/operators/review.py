"""What a reviewer does, as table operations: selections, and decisions as rows that replace each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.tokens import tokenize_on


def reading_key(rotation: Column, left: Column, top: Column) -> Column:
    """Order of words in a line by its rotation: upwards at 90, downwards at 270, leftwards at 180, else rightwards."""
    turn = F.pmod(rotation, F.lit(360))
    return F.when(turn == 90, -top).when(turn == 270, top).when(turn == 180, -left).otherwise(left).cast("double")


def selection_text(words: DataFrame) -> DataFrame:
    """selection, text: words(selection, line_id, line_top, line_left, rotation, left, top, text) in reading order, line by line."""
    rows = words.withColumn("k", reading_key(F.col("rotation"), F.col("left"), F.col("top")))
    line = rows.groupBy("selection", "line_id", "line_top", "line_left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ").alias("t"))
    return line.groupBy("selection").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.bround("line_top").alias("a"), "line_left", "line_id", "t"))), lambda x: x["t"]), " ").alias("text"))


def toggled(selected: Column, keys: Column) -> Column:
    """All keys selected: they are taken out; else the missing ones are added."""
    return F.when(F.size(F.array_except(keys, selected)) == 0, F.array_except(selected, keys)).otherwise(F.array_union(selected, keys))


def after_rejecting(category: Column) -> Column:
    return F.struct(category.alias("category"), F.lit(False).alias("tokenize"), F.lit(None).cast("string").alias("token"), F.lit(True).alias("rejected"))


def after_restoring(category: Column) -> Column:
    """Rejected is false, not unsaid, so that a person below consensus stays accepted."""
    return F.struct(category.alias("category"), (category == "ACCOUNT_NUMBER").alias("tokenize"), F.lit(None).cast("string").alias("token"), F.lit(False).alias("rejected"))


def after_update(old: Column, category: Column, tokenize: Column) -> Column:
    """A changed category loses its token; rejected stays as it was."""
    return F.struct(category.alias("category"), tokenize.alias("tokenize"), F.when(old["category"].eqNullSafe(category), old["token"]).alias("token"), old["rejected"].alias("rejected"))


def apply_actions(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions (entity, category, tokenize, token, rejected) after one action an entity: reject, restore, update or remove."""
    old = F.struct("category", "tokenize", "token", "rejected")
    rows = decisions.select("entity", old.alias("old")).join(actions.select("entity", "action", F.col("category").alias("new_category"), F.col("tokenize").alias("new_tokenize")), "entity", "full").where("action is null or action != 'remove'")
    category = F.coalesce("new_category", F.col("old.category"))
    new = F.when(F.col("action") == "reject", after_rejecting(category)).when(F.col("action") == "restore", after_restoring(category)).when(F.col("action") == "update", after_update(F.col("old"), category, F.col("new_tokenize"))).otherwise(F.col("old"))
    return rows.select("entity", new.alias("d")).select("entity", "d.category", "d.tokenize", "d.token", "d.rejected")


def set_token(decisions: DataFrame, entity: str, token: str) -> DataFrame:
    """The entity gets the token; an entity that shows it already gets it in writing too, so that the two are aliases."""
    holder = (F.col("entity") == entity) | (F.col("shown") == token)
    return decisions.withColumn("token", F.when(holder, token).otherwise(F.col("token")))


def effective(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """entity, category, tokenize, token as a reviewer sees them: the decision's, else the recommendation's, else the default."""
    d = decisions.select("entity", F.col("category").alias("dc"), F.col("tokenize").alias("dt"), F.col("token").alias("dk"))
    rows = recs.join(d, "entity", "left")
    category = F.coalesce("dc", "category")
    return rows.select("entity", category.alias("category"), tokenize_on(F.coalesce("dt", "tokenize"), category).alias("tokenize"), F.coalesce("dk", "token").alias("token"), (F.col("dc").isNotNull() & ~F.col("dc").eqNullSafe(F.col("category"))).alias("overridden"))


def visible(recs: DataFrame, manual: DataFrame, decisions: DataFrame) -> DataFrame:
    """entity, source: recommendations with occurrences, manual additions that aren't among them; rejected ones are hidden."""
    shown = recs.where("n_occ > 0").select("entity", F.lit("rec").alias("source"))
    rest = manual.select("entity").join(shown, "entity", "left_anti").select("entity", F.lit("manual").alias("source"))
    return shown.unionByName(rest).distinct().join(decisions.where("rejected").select("entity"), "entity", "left_anti")


def virtual_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Words, and for a line with content but without words the line itself as its word 0."""
    bare = lines.where("trim(content) != ''").join(words.select("page", "line_id").distinct(), ["page", "line_id"], "left_anti")
    whole = bare.select("page", "line_id", F.lit(0).alias("word_index"), F.trim("content").alias("text"), "left", "right")
    return words.select("page", "line_id", "word_index", "text", "left", "right").unionByName(whole)


def selection_boxes(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Occurrences of a selection, one a line: up to the line's edge where its first or last word is selected."""
    edge = words.groupBy("page", "line_id").agg(F.min("word_index").alias("lo"), F.max("word_index").alias("hi"))
    mine = words.where("selected").groupBy("page", "line_id").agg(F.min("word_index").alias("a"), F.max("word_index").alias("b"), F.min("left").alias("x0"), F.max("right").alias("x1"))
    rows = mine.join(edge, ["page", "line_id"]).join(lines.select("page", "line_id", F.col("left").alias("l"), F.col("right").alias("r"), "top", "bottom"), ["page", "line_id"])
    return rows.select("page", "line_id", F.when(F.col("a") == F.col("lo"), F.col("l")).otherwise(F.col("x0")).alias("left"), "top", F.when(F.col("b") == F.col("hi"), F.col("r")).otherwise(F.col("x1")).alias("right"), "bottom")


def snapshot(decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """Decisions as they are saved: those that keep their entity get in writing the token that the reviewer sees (shown: entity, token), unless they have one."""
    rows = decisions.join(shown.select("entity", F.regexp_replace("token", r"^\[|\]$", "").alias("seen")), "entity", "left")
    return rows.withColumn("token", F.when(F.coalesce("rejected", F.lit(False)), F.col("token")).otherwise(F.coalesce("token", "seen"))).drop("seen")


def with_matches(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """Boxes of a selection and the matches of its text in other lines: a line that the selection touches keeps the selection's box, others one match each."""
    key = ["page", "line_id"]
    first = Window.partitionBy(*key).orderBy("left", "top")
    other = matches.join(boxes.select(*key), key, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return boxes.unionByName(other.select(*boxes.columns))


def overlay(rows: DataFrame, use_derived: bool) -> DataFrame:
    """Boxes with the derived edges where there are any and they are wanted."""
    if not use_derived:
        return rows.drop("left_d", "right_d")
    return rows.withColumn("left", F.coalesce("left_d", "left")).withColumn("right", F.coalesce("right_d", "right")).drop("left_d", "right_d")


def stretched(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words of unrotated lines in one row, rescaled so that they fill their line from edge to edge."""
    whole = Window.partitionBy("page", "line_id")
    rows = words.withColumn("lo", F.min("left").over(whole)).withColumn("hi", F.max("right").over(whole)).withColumn("rows", F.max("top").over(whole) - F.min("top").over(whole))
    rows = rows.join(lines.select("page", "line_id", F.col("left").alias("l"), F.col("right").alias("r"), "rotation"), ["page", "line_id"])
    fits = (F.col("rotation") == 0) & (F.col("rows") <= 2) & (F.col("hi") > F.col("lo"))
    scale = lambda x: F.when(fits, F.col("l") + (x - F.col("lo")) * (F.col("r") - F.col("l")) / (F.col("hi") - F.col("lo"))).otherwise(x).cast("double")
    return rows.select("page", "line_id", "word_index", scale(F.col("left")).alias("left"), scale(F.col("right")).alias("right"))


def preview(entities: DataFrame, most: int = 3) -> DataFrame:
    """client_id and its first entities with '+N more'; a report of a few names."""
    rows = entities.groupBy("client_id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    more = F.when(F.size("e") > most, F.concat(F.lit(" +"), (F.size("e") - most).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("client_id", F.concat(F.array_join(F.slice("e", 1, most), ", "), more).alias("preview"))
