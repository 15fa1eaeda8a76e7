"""Mixing sources to target weights, in DataFrame functions only: raking (iterative proportional fitting) and sampling.

Documents are folded into cells of (source, language, topic) with their tokens. Raking scales the cells' weights to the
target tokens of one marginal after another until all three fit. A document's probability is its cell's weight per
token times a factor, at most 1; the factor is chosen so that the expected tokens meet the wanted share of the corpus.
A document is sampled when a hash of it, as a number from 0 to 1, lies below its probability, so the sample is the same
in any run and on any partitioning.

A probability of 1 cuts a cell's weight off, so where the share is large the sample misses the targets by more than it
has to. `bounded` rakes the probabilities themselves under that bound: each scaling looks for the factor with which the
expected tokens, cells cut off at their own tokens, come to the goal. A value whose goal exceeds its own tokens is kept
whole, and the others' goals rise in proportion until the share is met. marginals() tells what was wanted and reached.

Without given targets a marginal's shares are tempered: in proportion to tokens ** TEMPER. Values that the targets don't
name keep their own share of tokens, and all shares are scaled to 1.

Defined cases: a null source, language or topic is a value of its own; a null text counts as empty and has no tokens,
its probability is that of its cell (1 where a cell has no tokens at all); rows that repeat a document are sampled
alike; a null id is drawn by its text alone; very long texts are read whole; an empty table gives an empty result; other
columns may have any names, sample returns them as they are.

A topic is a column of the caller's (`topic`), or the topic of the text's words by seed words (seeded_topic), or by
default the form of the text (topic_of).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch

TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SHARE = 0.8  # expected tokens of the sample, as a share of the corpus
SWEEPS = 12
MOST_SWEEPS = 120
CELLS_A_FILE = 250_000
TOLERANCE = 1e-3
BOUNDED_SWEEPS = 12
BOUNDED_TOLERANCE = 1e-4  # of the sample's tokens
SEED = 20240229
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A document's topic by its form: what most of its marks are. Marks of one kind become one sign in a single pass and are counted by that."""
    kinds = {"\x02": "{}<>=;", "\x03": "0123456789", "\x04": "#*%&$!~^_"}
    signs = F.translate(text, "\x02\x03\x04" + "".join(kinds.values()), "   " + "".join(k * len(marks) for k, marks in kinds.items()))

    def told(t: Column) -> Column:
        n = F.char_length(t)
        holds = lambda sign: n - F.char_length(F.replace(t, F.lit(sign), F.lit("")))
        return F.when(n == 0, "empty").when(holds("|") * 50 > n, "table").when(holds("\x02") * 25 > n, "markup").when(holds("\x03") * 12 > n, "figures").when(holds("\x04") * 20 > n, "noise").when(n < 300, "short").when(n < 3000, "prose").otherwise("long")

    return F.element_at(F.transform(F.array(signs), told), 1)


def seeded_topic(text: Column, seeds: dict[str, list[str]]) -> Column:
    """A document's topic by its words: the topic whose seed words make up the largest part of the text's distinct words, by hash.

    Texts without any seed word have the topic of their form (topic_of). Of topics with as many words, the first by name.
    """
    words = F.transform(F.array_distinct(F.split(F.lower(text), "[^\\p{L}]+")), lambda w: F.xxhash64(w))
    n = {t: F.size(F.array_intersect(words, F.array(*(F.xxhash64(F.lit(w.lower())) for w in sorted(set(seeds[t])))))) for t in sorted(seeds)}
    best = F.array_max(F.array(*(F.struct(x.alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("topic")) for k, (t, x) in enumerate(n.items()))))
    return F.when(best["n"] > 0, best["topic"]).otherwise(topic_of(text))


def described(docs: DataFrame, *, id_col: str, text_col: str, topic: Column | None = None) -> DataFrame:
    """row (all columns of docs), _source, _lang, _topic (null as a value of its own), _tokens and _u, a number from 0 to 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    null = F.lit("\x00null")
    draw = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit(SEED))).otherwise(F.xxhash64(F.col(id_col), F.lit(SEED)))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("source").cast("string"), null).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), null).alias("_lang"),
        F.coalesce(topic_of(text) if topic is None else topic.cast("string"), null).alias("_topic"),
        _tokens(text).alias("_tokens"),
        (F.shiftrightunsigned(draw, 11).cast("double") / F.lit(float(1 << 53))).alias("_u"),
    )


def targets(cells: DataFrame, dimension: str, given: dict[str, float] | None, total: float) -> DataFrame:
    """(value, wanted): the tokens that each value of a marginal should have; they add up to total."""
    own = cells.groupBy(f"_{dimension}").agg(F.sum("tokens").alias("own")).where("own > 0")
    if given:
        names = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        rest = own.withColumn("share", F.coalesce(F.try_element_at(names, F.col(f"_{dimension}")), F.col("own") / total))
    else:
        rest = own.withColumn("share", F.pow(F.col("own").cast("double"), F.lit(TEMPER[dimension])))
    whole = rest.agg(F.sum("share")).first()[0] or 1.0
    return rest.where("share > 0").select(f"_{dimension}", (F.col("share") * (total / whole)).alias("wanted"))


def raked(cells: DataFrame, wanted: dict[str, dict[str, float]], work: Scratch) -> DataFrame:
    """cells with `weight`: tokens scaled until every marginal fits within TOLERANCE; with a warning, until SWEEPS more sweeps bring it no nearer."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    files = cells.count() // CELLS_A_FILE + 1
    current = work.put(cells.withColumn("weight", F.col("tokens").cast("double")), "raked-0", files)
    if not total:
        return current
    goals = {d: work.put(targets(cells, d, wanted.get(d), total), f"targets-{d}", files) for d in DIMENSIONS}
    least = off = float("inf")
    for sweep in range(1, MOST_SWEEPS + 1):
        for d in DIMENSIONS:
            factor = current.groupBy(f"_{d}").agg(F.sum("weight").alias("has")).join(goals[d], f"_{d}", "left")
            factor = factor.select(f"_{d}", F.when(F.col("has") > 0, F.coalesce("wanted", F.lit(0.0)) / F.col("has")).otherwise(0.0).alias(f"f_{d}"))
            current = current.join(factor, f"_{d}").withColumn("weight", F.col("weight") * F.col(f"f_{d}"))
        # before this sweep scaled it, the first marginal was off by as much as the sweep before had left
        current = work.put(current, f"raked-{sweep}", files)
        off = current.where("weight > 0").agg(F.max(F.abs(F.col("f_source") - 1))).first()[0]
        current = current.drop(*(f"f_{d}" for d in DIMENSIONS))
        if off is None or off < TOLERANCE:
            return current
        if sweep % SWEEPS == 0 and off > 0.9 * least:  # the targets contradict each other, or a cell that they need has no tokens
            break
        least = min(least, off) if sweep % SWEEPS == 0 else least
    warnings.warn(f"raking ended with a source {off:.3g} off its target (tolerance {TOLERANCE})", stacklevel=2)
    return current


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """cells with `probability`: weight per token times the factor that makes the expected tokens `share` of all."""
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    cells = cells.withColumn("rate", rate)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    factor = 0.0
    while True:  # the factor rises with each round that finds more cells to be full, and there are finitely many cells
        full = F.col("rate") * factor >= 1
        sums = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not sums["open"]:
            break
        new = (share * float(total) - float(sums["full"] or 0)) / float(sums["open"])
        if new <= factor * (1 + 1e-9):
            break
        factor = new
    return cells.withColumn("probability", F.when(F.col("rate").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("rate") * factor))).drop("rate")


def factor_to(goal: Column, most: Column, weight: Column, group: list[Column | str]) -> Column:
    """The factor f of a group with which the sum of least(most, f * weight) over its rows comes to goal, or cuts all rows off.

    That sum is the least of the lines that cut off the first k rows by weight / most; each line meets the goal no later
    than the sum does, so the factor is the greatest of theirs.
    """
    order = Window.partitionBy(*group).orderBy(F.try_divide(weight, most).desc_nulls_last())
    cut = F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return F.try_divide(goal - cut, F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)))


def within_own(wanted: DataFrame, own: DataFrame, dimension: str, share: float, total: float) -> DataFrame:
    """wanted, scaled so that no value has more than its own tokens and all have share * total, where their own tokens reach."""
    one = wanted.join(own, f"_{dimension}").withColumn("line", factor_to(F.lit(share * total), F.col("own"), F.col("wanted"), [F.lit(1)]))
    return one.withColumn("f", F.max("line").over(Window.partitionBy(F.lit(1)))).select(f"_{dimension}", F.least("own", F.col("wanted") * F.col("f")).alias("wanted"))


def bounded_probabilities(cells: DataFrame, wanted: dict[str, dict[str, float]], share: float, work: Scratch) -> DataFrame:
    """cells with `probability`: raked so that the expected tokens meet every marginal as far as the cells' own tokens allow."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumn("probability", F.lit(1.0))
    goals, files = {}, cells.count() // CELLS_A_FILE + 1
    for d in DIMENSIONS:
        own = cells.groupBy(f"_{d}").agg(F.sum("tokens").cast("double").alias("own"))
        goals[d] = work.put(within_own(targets(cells, d, wanted.get(d), total), own, d, share, total), f"goals-{d}", files)
    most, open_ = F.col("tokens").cast("double"), F.col("open")
    current = cells.withColumn("open", F.col("weight") * share)
    for sweep in range(1, BOUNDED_SWEEPS + 1):
        for d in DIMENSIONS:
            group = Window.partitionBy(f"_{d}")
            current = current.join(goals[d], f"_{d}", "left").withColumns({"line": factor_to(F.coalesce("wanted", F.lit(0.0)), most, open_, [f"_{d}"]), f"has_{d}": F.sum(F.least(most, open_)).over(group) - F.coalesce("wanted", F.lit(0.0))})
            current = current.withColumn("open", open_ * F.coalesce(F.max("line").over(group), F.lit(0.0))).drop("wanted", "line")
        current = work.put(current, f"bounded-{sweep}", files)
        # what this sweep found before each scaling, tokens off the goal, in parts of the sample's tokens
        off = current.agg(F.greatest(*(F.max(F.abs(f"has_{d}")) for d in DIMENSIONS))).first()[0] / (share * total)
        current = current.drop(*(f"has_{d}" for d in DIMENSIONS))
        if off < BOUNDED_TOLERANCE:
            break
    total_line = current.withColumn("line", factor_to(F.lit(share * total), most, open_, [F.lit(1)]))
    factor = total_line.agg(F.max("line")).first()[0] or 0.0
    return current.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), open_ * factor / F.col("tokens"))).otherwise(1.0)).drop("open")


def marginals(mixed: DataFrame) -> DataFrame:
    """Of what mix() gives: dimension, value, and its share of tokens: own, wanted (by weight), expected and in the sample."""
    parts = {"own": F.col("n_tokens"), "wanted": F.col("weight"), "expected": F.col("n_tokens") * F.col("probability"), "in_sample": F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)}
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in zip(DIMENSIONS, ("source", "lang", "topic"), strict=True)))).alias("at")
    sums = mixed.select(pairs, *(x.cast("double").alias(k) for k, x in parts.items())).groupBy("at.dimension", "at.value").agg(*(F.sum(k).alias(k) for k in parts))
    whole = Window.partitionBy("dimension")
    return sums.select("dimension", "value", *(F.try_divide(F.col(k), F.sum(k).over(whole)).alias(k) for k in parts))


def _tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("bigint")


def _cells(rows: DataFrame, wanted: dict[str, dict[str, float]] | None, share: float, bounded: bool, work: Scratch) -> DataFrame:
    cells = work.put(rows.groupBy(*(f"_{d}" for d in DIMENSIONS)).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")), "cells", 8)
    weighed = raked(cells, wanted or {}, work)
    return work.put(bounded_probabilities(weighed, wanted or {}, share, work) if bounded else probabilities(weighed, share), "cells-out", 8)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", wanted: dict[str, dict[str, float]] | None = None, share: float = SHARE, topic: Column | None = None, bounded: bool = False) -> DataFrame:
    """One row per document: id, source, lang, topic, n_tokens, weight (its raked tokens), probability and sampled."""
    work = Scratch(docs.sparkSession, "mixing")
    keys = [f"_{d}" for d in DIMENSIONS]
    rows = described(docs, id_col=id_col, text_col=text_col, topic=topic)
    rows = work.put(rows.select(F.col("row").getField(id_col).alias("_id"), F.col("row.source").alias("_s"), F.col("row.lang").alias("_l"), *keys, "_tokens", "_u"), "rows")  # the texts are read once
    cells = _cells(rows, wanted, share, bounded, work)
    weight = F.when(F.col("tokens") > 0, F.col("_tokens") * F.col("weight") / F.col("tokens")).otherwise(0.0)
    joined = rows.join(cells.select(*keys, "tokens", "weight", "probability"), keys)
    return joined.select(F.col("_id").alias(id_col), F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), weight.alias("weight"), "probability", (F.col("_u") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", wanted: dict[str, dict[str, float]] | None = None, share: float = SHARE, topic: Column | None = None, bounded: bool = False) -> DataFrame:
    """The sampled documents, with their columns."""
    keys = [f"_{d}" for d in DIMENSIONS]
    rows = described(docs, id_col=id_col, text_col=text_col, topic=topic)
    cells = _cells(rows, wanted, share, bounded, Scratch(docs.sparkSession, "mixing"))
    return rows.join(cells.select(*keys, F.col("probability").alias("_probability")), keys).where("_u < _probability").select("row.*")
