"""MinHash near-dedup by a signature-coordinate inverted join.

Every distinct shingle set has a MinHash signature and is posted under each (coordinate, value) pair. Two sets with
Jaccard similarity 0.8 agree in 51 of 64 coordinates on average; fewer than MATCHES = 38 come up about once in 40,000
such pairs, so the join keeps pairs with at least that many collisions and then compares the full sets.

Prefix and skip merging: coordinate-value pairs are ordered by how many sets carry them. Two sets with MATCHES common
pairs share one of the rarest (64 - MATCHES + 1) of either, so only these are merged; the longer lists are skipped and
looked at only when the collisions of a candidate are counted. Values of a single set end the search for most sets
at once, and a passage that half the corpus shares is in the skipped lists.

A posting list is never expanded into all its pairs. In each of STAR_ROUNDS rounds every list is compared with one
leader of its own; sets that turn out linked fall into one component. The last step looks at the pairs whose components still
differ, in all lists, and retains those with enough collisions, each from one list; longer lists are compared block by
block, and only verified links leave a block. No list is cut.

Defined cases: a null or blank text has an empty set (n_shingles 0) and no links; rows with a null id have no links,
component_id null and stay; equal sets are one node whatever their texts; rows that repeat an id are one document; of
a component the least id stays, so ties don't arise; very long texts are compared whole; an empty table gives an empty
result; other columns may have any names and are returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ODD, Scratch, WordHashes, ascii_words, broadcast_if_small, fresh, mix, shingle_hashes, worker_task
from veilspark.llm.graph import components

COORDINATES = 64
MATCHES = 38
WIDTH = 5
SIMILARITY = 0.8
STAR_ROUNDS = 2
ROWS_A_FILE = 250_000
LONG_LIST = 64  # lists of more nodes are compared by blocks
BLOCK = 1024
SLICE = 250  # documents that a worker has in hand
ROWS_A_TASK = 20_000  # of a stored table that is cheap to make


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each of the `coordinates` multiply-add permutations, marked with its coordinate."""
    a = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * ODD[0]) | np.uint64(1)
    b = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * ODD[1])
    out = np.full(coordinates, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[i : i + 4096, None] * a + b).min(axis=0))
    return mix(out ^ a)


@worker_task
def _signed(batches: Iterator[pa.RecordBatch], width: int, coordinates: int, whole: bool) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(texts), SLICE):
            part = texts.slice(at, SLICE)
            sets = [np.unique(shingle_hashes(ascii_words(x.as_py()), hashes, width)) for x in part]
            signs = [signature(s, coordinates).view(np.int64) if len(s) else None for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            listed = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            if whole:
                columns = [ids.slice(at, SLICE), sizes, listed(signs), listed([s.view(np.int64) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sig", "shingles"])
            else:
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, SLICE), sizes, keys, listed(signs)], ["id", "n_shingles", "set_key", "sig"])


def classes(docs: DataFrame, *, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """(id, n_shingles, set_key, sig) per row; set_key is a 128-bit digest of the whole set."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _signed(it, width, coordinates, False), f"id {id_type}, n_shingles bigint, set_key binary, sig array<bigint>")


def _prefixes(nodes: DataFrame, work: Scratch, matches: int, files: int) -> DataFrame:
    """The postings that take part in merging: key, coordinate c, node, n, mask (the coordinates in the node's prefix) and brief (32 bits of each coordinate)."""
    posted = nodes.select("node", F.posexplode("sig").alias("c", "key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    lists = posted.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key", "c"))).alias("keys"))  # at most a key for each coordinate
    lists = lists.where(F.size("keys") >= matches).select("node", F.expr(f"slice(keys, 1, size(keys) - {matches - 1})").alias("keys"))
    lists = work.put(lists.select("node", F.expr("transform(keys, k -> named_struct('key', k.key, 'c', k.c))").alias("keys")), "prefixes", files)
    postings = lists.select("node", F.explode("keys").alias("k")).select(F.col("k.key").alias("key"), F.col("k.c").alias("c"), "node")
    longer = postings.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    mask = F.expr("aggregate(keys, 0L, (m, k) -> m | shiftleft(1L, k.c))")
    briefs = lists.select("node", mask.alias("mask")).join(nodes.select("node", "n", F.expr("transform(sig, x -> cast(x & 2147483647L as int))").alias("brief")), "node")
    return work.put(postings.join(longer, "key").join(briefs, "node"), "postings", 4 * files)


def _close(percent: int, matches: int) -> str:
    """SQL: sizes allow the similarity, and enough coordinates collide."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and aggregate(zip_with(brief_a, brief_b, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) >= {matches}"


def _with_leaders(current: DataFrame, round_: int, matches: int, percent: int) -> DataFrame:
    """Pairs of a list's leader and each of its nodes in another component. A list's leader depends on the list, so a node meets as many leaders as it has lists."""
    turn = F.xxhash64("node", "key", F.lit(round_)) if round_ else F.xxhash64("node", "key")
    lead = current.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "label", "n", "brief")).alias("lead"))
    lead = lead.select(F.col("key"), *(F.col(f"lead.{c}").alias(f"{c}_a") for c in ("node", "label", "n", "brief")))
    rows = current.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "brief")))
    pairs = rows.join(lead, "key").where(f"label_a != label_b and {_close(percent, matches)}")
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _open_pairs(rows: DataFrame, matches: int, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that share one of the shorter lists and are close.

    The join itself counts the collisions, and a pair comes from one list only: that of the least coordinate that both
    prefixes hold and that collides.
    """
    side = lambda p: rows.select("key", *(F.col(c).alias(f"{c}_{p}") for c in ("node", "label", "c", "n", "mask", "brief")))
    earlier = "exists(sequence(0, c_a), i -> i < c_a and brief_a[i] = brief_b[i] and (shiftrightunsigned(mask_a & mask_b, i) & 1L) = 1L)"
    fits = F.expr(f"node_a < node_b and label_a != label_b and {_close(percent, matches)} and not {earlier}")
    a, b = side("a"), side("b")
    return a.join(b, (a["key"] == b["key"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _linked_in_block(table: pa.Table, matches: int, percent: int) -> pa.Table:
    """The links between two blocks of one list (or inside one block): the same pairs as in _open_pairs, verified on the spot.

    Pairs whose components have met in this block are passed over; only links leave.
    """
    node, label, n, first = (table.column(c).to_numpy() for c in ("node", "label", "n", "side"))
    bits = ((table.column("mask").to_numpy()[:, None] >> np.arange(64)) & 1).astype(bool)
    brief = np.array(table.column("brief").to_pylist(), np.int32)
    sets = [np.array(x, np.int64) for x in table.column("shingles").to_pylist()]
    c = table.column("c")[0].as_py()
    inside = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    top = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    right = np.arange(len(node)) if inside else np.flatnonzero(first == 1)
    for a in range(len(node)) if inside else np.flatnonzero(first == 0):
        b = right[right > a] if inside else right
        b = b[(label[b] != label[a]) & (node[b] != node[a]) & (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a]))]
        same = brief[b] == brief[a]
        b = b[(same.sum(axis=1) >= matches) & ~(same[:, :c] & bits[b, :c] & bits[a, :c]).any(axis=1)]
        for k in b.tolist():
            x, y = root(int(label[a])), root(int(label[k]))
            if x != y:
                common = len(np.intersect1d(sets[a], sets[k], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[k]) - common):
                    top[max(x, y)] = min(x, y)
                    out.append((int(node[a]), int(node[k])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _open_links(rows: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links in the longer lists: each is dealt into blocks of about BLOCK nodes, and pairs of blocks are compared in tasks of their own."""
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    rows = rows.withColumn("side", (F.col("mine") > F.col("other")).cast("int")).join(sets.select("node", "shingles"), "node")
    return rows.select("key", "i", "j", "side", "node", "label", "c", "n", "mask", "brief", "shingles").groupBy("key", "i", "j").applyInArrow(lambda t: _linked_in_block(t, matches, percent), "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda p: sets.select(F.col("node").alias(p), F.col("n").alias(f"n_{p}"), F.col("shingles").alias(f"set_{p}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.expr(f"100L * common >= {percent}L * (n_a + n_b - common)")).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, work: Scratch, *, id_col: str, text_col: str, width: int, coordinates: int, matches: int, percent: int) -> DataFrame:
    """(node, label) for the nodes that have links: the least node that similar sets lead to."""
    few = docs.count() // ROWS_A_TASK + 2
    postings = _prefixes(nodes, work, matches, few)
    wanted = work.put(postings.select("node").distinct(), "wanted", few)
    n_wanted = wanted.count()
    nothing = nodes.select("node", F.col("node").alias("label")).limit(0)
    if not n_wanted:
        return nothing
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(broadcast_if_small(wanted, n_wanted, 16), "node", "left_semi")
    sets = texts.mapInArrow(lambda it: _signed(it, width, coordinates, True), "node bigint, n bigint, sig array<bigint>, shingles array<bigint>")
    # an id that carries several texts stands for the set it was posted with
    sets = work.put(sets.join(nodes.select("node", F.col("sig").alias("own")), "node").where("sig = own").drop("own", "sig").dropDuplicates(["node"]), "sets", 2 * few)
    files = n_wanted // ROWS_A_FILE + 1
    found = tested = label = None
    for r in range(STAR_ROUNDS + 1):
        current = postings.withColumn("label", F.col("node")) if label is None else postings.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if r < STAR_ROUNDS:
            pairs = _with_leaders(current, r, matches, percent)
        else:
            lists = current.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x != y").select("key", "m")
            current = work.put(current.join(lists, "key"), "open", 2 * few)
            pairs = _open_pairs(current.where(F.col("m") <= LONG_LIST), matches, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = work.put(pairs, f"pairs-{r}", min(4 * few, 64 * files) if r < STAR_ROUNDS else None)
        new = _verified(pairs, sets, percent)
        if r == STAR_ROUNDS:
            new = new.unionByName(_open_links(current.where(F.col("m") > LONG_LIST), sets, matches, percent))
        new = work.put(new, f"links-{r}", min(4 * few, 64 * files) if r < STAR_ROUNDS else None)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            label = components(found, work, f"components-{r}", files)
    return nothing if label is None else label


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links lead to), kept (id = component_id)."""
    work = Scratch(docs.sparkSession, "near-dedup")
    percent = round(similarity * 100)
    few = docs.count() // ROWS_A_TASK + 2
    rows = work.put(classes(docs, id_col=id_col, text_col=text_col, width=width, coordinates=coordinates), "signatures")
    named = rows.where("set_key is not null and id is not null")
    reps = work.put(named.groupBy("set_key").agg(F.min("id").alias("node")), "classes", few)
    nodes = named.join(reps, "set_key").where("id = node").select("node", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["node"])
    nodes = work.put(nodes, "nodes", few)
    label = links(docs, nodes, work, id_col=id_col, text_col=text_col, width=width, coordinates=coordinates, matches=matches, percent=percent)
    where_to = reps.join(label, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    out = rows.select("id", "n_shingles", "set_key").join(where_to, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay, with their columns: one of each component, every one without links."""
    work, name = Scratch(docs.sparkSession, "near-dedup-kept"), fresh("_gone", docs.columns)
    gone = work.put(near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity).where("not kept").select(F.col(id_col).alias(name)).distinct(), "gone", docs.count() // ROWS_A_TASK + 2)
    return docs.join(broadcast_if_small(gone, gone.count(), 16), F.col(id_col) == F.col(name), "left_anti")
