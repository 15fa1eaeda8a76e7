"""One-permutation MinHash fingerprints in DataFrame functions only.

Each word shingle is hashed once; the leading BITS_OF_BIN bits of the hash choose its bin, and a bin keeps its least
hash. The hashes and one sentinel for each bin (greater than any hash of it) are sorted together, so the first entry
of each run of equal leading bits is the bin's least hash, or the sentinel of an empty bin. Empty bins are filled by
optimal densification: bin i looks at bins in an order of its own, given by universal hashes of (i, attempt), and
takes the first that isn't empty. KEPT_BITS low bits of a hash of (value, bin) are kept for every bin, so that bins
filled from one value still agree by chance independently, and packed into a hexadecimal string. Two fingerprints agree
by chance in one bin of 2**KEPT_BITS; likeness corrects for that.

Defined cases: a null text counts as empty; a text with fewer words than a shingle is one shingle; a text without
words has the fingerprint '' and likeness 1 to another such text, 0 to all others; equal texts have equal
fingerprints; rows with equal ids follow each other by text, null ids come last; very long texts are taken whole; ids may
be of any type that has an order; an empty table gives an empty result; other columns may have any names, they are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
BITS_OF_BIN = 8
KEPT_BITS = 4
ATTEMPTS = 10
ROWS_A_RANGE = 2000  # of the table in order of ids, in which documents meet their next one
MOST_RANGES = 16_384
BINS = 1 << BITS_OF_BIN
VALUE_BITS = 64 - BITS_OF_BIN
HIGHEST = (1 << VALUE_BITS) - 1  # the value of a sentinel


def _sentinels() -> Column:
    return F.expr(f"transform(sequence(-{BINS // 2}, {BINS // 2 - 1}), b -> shiftleft(cast(b as bigint), {VALUE_BITS}) + {HIGHEST}L)")


def _step(attempt: int) -> tuple[int, int]:
    """An odd factor and an offset: i -> (factor * i + offset) mod BINS is a permutation of the bins."""
    return (2 * ((attempt * 0x9E3779B1 >> 7) % (BINS // 2)) + 1, (attempt * 0x85EBCA6B >> 5) % BINS)


def shingles(words: str, width: int) -> str:
    """SQL for the hashes of all shingles of an array of words."""
    return f"if(size({words}) = 0, array(), if(size({words}) <= {width}, array(xxhash64({words})), transform(sequence(1, size({words}) - {width - 1}), i -> xxhash64(slice({words}, i, {width})))))"


def bins(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds `out`: the dense array of BINS values (KEPT_BITS low bits each), or an empty array for a text without words."""
    words = f"filter(split(lower(coalesce({text}, '')), '[ \\\\t-\\\\r]+'), w -> w != '')"
    df = df.withColumn("_words", F.expr(words)).withColumn("_hashes", F.expr(shingles("_words", width)).cast("array<bigint>"))
    df = df.withColumn("_sorted", F.sort_array(F.concat("_hashes", _sentinels())))
    runs = f"filter(_sorted, (x, i) -> i = 0 or shiftright(x, {VALUE_BITS}) != shiftright(_sorted[i - 1], {VALUE_BITS}))"
    df = df.withColumn("_least", F.expr(f"transform({runs}, x -> if((x & {HIGHEST}L) = {HIGHEST}L, null, x))"))
    looks = ", ".join(f"_least[({a} * i + {c}) % {BINS}]" for a, c in map(_step, range(1, ATTEMPTS + 1)))
    # after ATTEMPTS looks: the bin that isn't empty with the least hash of (i, bin), as if every further bin had been tried in that order
    rest = "array_min(transform(_used, j -> struct(xxhash64(i, j) as h, _least[j] as v))).v"
    df = df.withColumn("_used", F.expr(f"filter(sequence(0, {BINS - 1}), j -> _least[j] is not null)"))
    df = df.withColumn(out, F.expr(f"if(size(_used) = 0, cast(array() as array<int>), transform(sequence(0, {BINS - 1}), i -> cast(xxhash64(coalesce(_least[i], {looks}, {rest}), i) & {(1 << KEPT_BITS) - 1}L as int)))"))
    return df.drop("_words", "_hashes", "_sorted", "_least", "_used")


def packed(values: str) -> Column:
    """The fingerprint as a hexadecimal string, KEPT_BITS bits a bin."""
    return F.expr(f"array_join(transform({values}, v -> lower(hex(v))), '')")


def likeness(a: str, b: str) -> Column:
    """The bias-corrected estimate of the Jaccard similarity, from 0 to 1."""
    chance = 2.0**-KEPT_BITS
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e)) / {BINS}D"
    return F.expr(f"case when size({a}) = 0 or size({b}) = 0 then if(size({a}) = size({b}), 1D, 0D) else greatest(0D, least(1D, ({same} - {chance}D) / {1 - chance}D)) end")


def ranges(docs: DataFrame, id_col: str, rows_a_range: int = ROWS_A_RANGE) -> Column:
    """The number of the id's range: quantiles of the ids bound the ranges; they are looked up in two steps of about the square root of their number."""
    n = docs.select(id_col).count()
    wanted = max(1, min(MOST_RANGES, -(-n // rows_a_range)))
    width = int(wanted**0.5) + 1
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        # any other ordered type: the least id of each range that Spark's range partitioning makes of the ids alone
        ids = docs.select(F.col(id_col).alias("id")).where("id is not null").repartitionByRange(wanted, "id").withColumn("range", F.spark_partition_id())
        bounds = sorted(r["least"] for r in ids.groupBy("range").agg(F.min("id").alias("least")).collect())[1:]  # at most MOST_RANGES rows
        kind = docs.schema[id_col].dataType
        return looked_up(bounds, width, F.col(id_col), lambda part: F.array(*(F.lit(x).cast(kind) for x in part)))
    fractions = [i / wanted for i in range(1, wanted)]
    bounds = docs.agg(F.percentile_approx(id_col, fractions, max(10_000, 20 * wanted))).first()[0] if fractions else []
    bounds = sorted(set(bounds or []))
    return looked_up(bounds, width, F.col(id_col), lambda part: F.expr(f"array({','.join(f'{x}L' for x in part)})"))


def looked_up(bounds: list, width: int, at: Column, listed: Callable[[list], Column]) -> Column:
    """How many bounds are at most `at`, in blocks of `width` bounds; -1 for null."""
    if not bounds:
        return F.when(at.isNull(), -1).otherwise(0)
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    coarse = F.size(F.filter(listed([b[0] for b in blocks]), lambda x: x <= at)) - 1
    fine = F.array(*map(listed, blocks))
    inside = F.size(F.filter(fine[F.greatest(coarse, F.lit(0))], lambda x: x <= at))
    return F.when(at.isNull(), -1).otherwise(F.when(coarse < 0, 0).otherwise(coarse * width + inside))


def with_followers(rows: DataFrame) -> DataFrame:
    """rows(id, text) with range, guest: each range also holds, as its guest, the first row of the range that follows.

    The order is by descending id, so the range below follows; the highest range follows the lowest. A guest row comes
    after all others of its range, and there is one for each range, whatever the number of rows.
    """
    rows = rows.withColumn("range", ranges(rows, "id"))
    tops = rows.groupBy("range").agg(F.max("id").alias("top"))  # at most MOST_RANGES + 1 rows
    order = Window.orderBy("range")
    above = F.coalesce(F.lead("range").over(order), F.first("range").over(order))
    tops = tops.withColumn("above", above)
    firsts = rows.join(F.broadcast(tops), (rows["range"] == tops["range"]) & rows["id"].eqNullSafe(tops["top"])).select("above", "id", "text")
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("above").orderBy("text"))).where("n = 1")
    return rows.withColumn("guest", F.lit(False)).unionByName(firsts.select("id", "text", F.col("above").alias("range"), F.lit(True).alias("guest")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of docs: id and its fingerprint (hexadecimal)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bins(rows, "text", "values", width).select(F.col("id").alias(id_col), packed("values").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next document), and likenesses."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = bins(with_followers(rows).repartition("range"), "text", "values", width)
    following = Window.partitionBy("range").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(following)).withColumn("next_values", F.lead("values").over(following)).where("not guest")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("_cut", F.expr("cast(n_chars div 3 as int)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - _cut), substring(next_text, 1, _cut))"))
    rows = rows.select("id", "n_chars", "edited", "values", likeness("values", "next_values").alias("near_next"))
    rows = bins(rows, "edited", "edited_values", width)
    return rows.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed("values").alias("fingerprint"), packed("edited_values").alias("edited_fingerprint"), likeness("values", "edited_values").alias("near_edited"), "near_next")
