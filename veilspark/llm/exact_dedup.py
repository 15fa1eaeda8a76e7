"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

Every text has a 64-bit hash. A survey counts rows by the leading bits of the hash, and the directory doubles (takes
one more bit) wherever a bucket would hold more than `capacity` rows; where the surveyed bits don't suffice, more are
surveyed, up to all 64, so only rows of one hash stay together. A bucket is a range of hashes. Its rows, texts
included, go to one owner task, which sorts them by hash and bytes, chains the different texts of one hash and folds
equal ones; the owners' files in the shared folder are the index, and they hold the answer.

A hash that `HOT` rows or more carry doesn't go to an owner: the map-side half of a grouping by (hash, text) folds its
copies before anything is shuffled, and its rows meet the folded texts in a join by bytes, dealt over salts of HOT rows
each (or broadcast, where the texts' size allows it). HOT follows the number of rows, so at most MOST_HOT hashes are
hot, whatever the corpus.

Defined cases: a null text counts as empty; rows that share the largest id of a group are one document and all stay;
a null id never wins over another and a group of only null ids stays whole (in exact_duplicates; drop_duplicates keeps
one row of each text); very long texts are compared whole; an empty table gives an empty result; ids may be of any type
that has an order; other columns may have any names, exact_duplicates neither reads nor returns them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, broadcast_if_small

CAPACITY = 4096  # rows of a bucket before it is split
MOST_BUCKETS = 500_000  # beyond CAPACITY times as many rows, buckets take more rows, so that the directory can be broadcast
SPARE_BITS = 2  # surveyed beyond those that even buckets need
HOT = 1024  # rows of a hash from which its copies are folded before the shuffle
MOST_HOT = 1_000_000
PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "binary", "boolean", "date", "timestamp", "timestamp_ntz")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leading(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("bigint")


def directory(entries: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(prefix, depth, bucket) for each used prefix of so many leading bits: the least depth at which the bucket isn't overfull.

    entries: prefix, and n where a row stands for several. A bucket that holds too many is split by every doubling, so
    a prefix lies one below the deepest of its ancestors that are overfull.
    """
    counts = entries.groupBy(F.col("prefix").cast("bigint").alias("prefix")).agg((F.sum("n") if "n" in entries.columns else F.count("*")).alias("n"))
    at = lambda depth: F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.col("prefix"), (bits - depth).cast("int")))
    above = counts.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max(bits - 1, 0))))).withColumn("ancestor", at(F.col("depth")))
    above = above.withColumn("total", F.sum("n").over(Window.partitionBy("depth", "ancestor")))
    split = F.col("total") > capacity if bits else F.lit(False)
    leaves = above.groupBy("prefix").agg(F.coalesce(F.max(F.when(split, F.col("depth") + 1)), F.lit(0)).alias("depth"))
    return leaves.withColumn("bucket", F.concat_ws("_", F.col("depth").cast("string"), at(F.col("depth")).cast("string")))


def survey(rows: DataFrame, work: Scratch, n: int, capacity: int, bits: int | None, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """(prefixes with n rows, hot hashes with n rows, bits): as many bits as it takes, so that an overfull prefix is of one hash."""
    if bits is None:
        bits = max(0, math.ceil(math.log2(max(n, 1) / capacity)) + SPARE_BITS)
    while True:
        counted = rows.groupBy("hash").agg(F.count("*").alias("n"))
        cold = F.col("n") < hot
        found = counted.groupBy(leading(F.col("hash"), bits).alias("prefix")).agg(F.sum(F.when(cold, F.col("n"))).alias("n"), F.min(F.when(cold, F.col("hash"))).alias("lo"), F.max(F.when(cold, F.col("hash"))).alias("hi"), F.collect_list(F.when(~cold, F.struct("hash", "n"))).alias("hot"))
        found = work.put(found, f"survey-{bits}")
        if bits == 64 or found.where(f"n > {capacity} and lo != hi").isEmpty():
            return found.where("n is not null").select("prefix", "n"), found.select(F.explode("hot").alias("h")).select("h.hash", "h.n"), bits
        bits = min(64, bits + 4)


def dealt(docs: DataFrame, work: Scratch, *, text_col: str, capacity: int, max_depth: int | None, hash_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None, int]:
    """(owned, hot, rows of a salt): rows with their bucket, at their owners; and the rows of hot hashes with n, if there are any.

    Both hold row (a struct of the columns of docs), hash and text.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = rows.withColumn("hash", hash_of(text))
    n = docs.count()
    capacity, hot = max(capacity, n // MOST_BUCKETS), max(HOT, n // MOST_HOT)
    prefixes, hot_hashes, bits = survey(docs.select(hash_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("hash")), work, n, capacity, max_depth, hot)
    found = work.put(directory(prefixes, capacity, bits), "directory")
    own, many = rows, None
    if not hot_hashes.isEmpty():  # at most MOST_HOT rows, as each stands for n // MOST_HOT rows or more
        own = rows.join(F.broadcast(hot_hashes.select("hash")), "hash", "left_anti")
        many = rows.join(F.broadcast(hot_hashes), "hash").withColumn("text", text)
    placed = own.withColumn("prefix", leading(F.col("hash"), bits)).join(broadcast_if_small(found, found.count(), 32, 64 << 20), "prefix")
    return placed.repartition("bucket").withColumn("text", text), many, hot


def postings(docs: DataFrame, work: Scratch, *, id_col: str, text_col: str, capacity: int, max_depth: int | None, hash_of: Callable[[Column], Column], digest_of: Callable[[Column], Column]) -> DataFrame:
    """Writes the index and returns it, a row for each document: id, bucket, hash, chain (the text's place among those of its hash), keep_id, group_size, digest, text_sha256, n_bytes."""
    owned, many, hot = dealt(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), work, text_col="text", capacity=capacity, max_depth=max_depth, hash_of=hash_of)
    chained = Window.partitionBy("bucket", "hash").orderBy("text")
    equal = Window.partitionBy("bucket", "hash", "text")
    told = [digest_of(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("bigint").alias("n_bytes")]
    owned = owned.withColumn("id", F.col("row.id")).select("bucket", "hash", "id", "text", (F.dense_rank().over(chained) - 1).cast("bigint").alias("chain"), F.max("id").over(equal).alias("keep_id"), F.count("*").over(equal).alias("group_size"))
    out = owned.select("id", "bucket", "hash", "chain", "keep_id", "group_size", *told)
    if many is not None:
        entries = many.groupBy("hash", "text").agg(F.max("row.id").alias("keep_id"), F.count("*").alias("group_size"), F.first("n").alias("n"))
        entries = entries.withColumn("chain", (F.row_number().over(Window.partitionBy("hash").orderBy("text")) - 1).cast("bigint"))
        entries = work.put(entries.select("hash", "text", "n", "keep_id", "group_size", "chain", *told), "hot")
        size = entries.agg(F.sum(F.col("n_bytes") + 200)).first()[0]
        salts = F.ceil(F.col("n") / hot).cast("int")
        met = many.select("row.id", "hash", "text", F.pmod(F.xxhash64("row.id"), salts).cast("int").alias("salt"))
        found = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))) if size > 16 << 20 else F.broadcast(entries)
        met = met.join(found, ["hash", "text", "salt"] if size > 16 << 20 else ["hash", "text"])
        out = out.unionByName(met.select("id", F.concat(F.lit("hot_"), F.hex("hash")).alias("bucket"), "hash", "chain", "keep_id", "group_size", "digest", "text_sha256", "n_bytes"))
    return work.put(out, "index")


def build_index(docs: DataFrame, work: Scratch, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int | None = None, hash_of: Callable[[Column], Column] = text_hash, digest_of: Callable[[Column], Column] = text_digest) -> DataFrame:
    """Writes the index and returns its entries, one for each distinct text: bucket, hash, chain, digest, n_bytes, keep_id, group_size."""
    rows = postings(docs, work, id_col=id_col, text_col=text_col, capacity=capacity, max_depth=max_depth, hash_of=hash_of, digest_of=digest_of)
    return rows.groupBy("bucket", "hash", "chain").agg(F.first("digest").alias("digest"), F.first("n_bytes").alias("n_bytes"), F.max("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int | None = None, hash_of: Callable[[Column], Column] = text_hash, digest_of: Callable[[Column], Column] = text_digest) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_bytes and chain; the largest id of equal texts stays."""
    work = Scratch(docs.sparkSession, "exact-dedup")
    found = postings(docs, work, id_col=id_col, text_col=text_col, capacity=capacity, max_depth=max_depth, hash_of=hash_of, digest_of=digest_of)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", "chain")


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int | None = None, hash_of: Callable[[Column], Column] = text_hash) -> DataFrame:
    """The documents that stay, with their columns: one row of each text, that of the largest id (null ids come last).

    Of several rows with that id and text, one stays, chosen by a hash of its plain columns. Rows go to the owners
    whole, so the documents are read twice (survey, owners) and shuffled once.
    """
    work = Scratch(docs.sparkSession, "exact-dedup-kept")
    owned, many, _ = dealt(docs, work, text_col=text_col, capacity=capacity, max_depth=max_depth, hash_of=hash_of)
    tie = F.xxhash64(*(F.col("row").getField(c) for c, kind in docs.dtypes if kind in PLAIN or kind.startswith("decimal")))
    rank = F.struct(F.col("row").getField(id_col).alias("id"), tie.alias("tie"))  # null ids sort lowest
    first = Window.partitionBy("bucket", "hash", "text").orderBy(F.col("rank").desc())
    kept = owned.withColumn("rank", rank).withColumn("place", F.row_number().over(first)).where("place = 1").select("row")
    if many is not None:
        kept = kept.unionByName(many.groupBy("hash", "text").agg(F.max_by("row", rank).alias("row")).select("row"))
    return kept.select("row.*")
