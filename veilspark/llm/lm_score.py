"""Perplexity by an interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped by workers.

Training, in three passes over partitions; each folds what it counts before anything is shuffled, and shuffles sorted
arrays, not rows:
1. Words: hashes and counts, by ranges of the hash; each range is written as a sorted array. A word's id is its place
   in the sorted order of all hashes, from 1; id 0 is every unknown word.
2. Pairs (context id, id) and counts. A shard holds the pairs of its contexts; contexts that alone would fill a large
   part of a shard are spread over all shards by pair. Each is written as a sorted array of 64-bit keys with counts.
3. What a context needs (its total and how many of its pairs occur once, twice, more often) and how many contexts each
   word continues, by ranges of ids.
The number of shards follows the corpus, so a shard's size doesn't. Scoring maps the arrays into memory and looks keys
up by binary search; a worker holds the pages that it touches, not the model.

p(w | u) = max(c(u w) - D(c), 0) / c(u) + g(u) q(w); q(w) = max(k(w) - E(k), 0) / K + h / (V + 1), where k(w) is the
number of contexts of w, K their sum, and D and E the three discounts of modified Kneser-Ney from counts of counts. The
end of a text is a token; it is also the context of the first word. Probabilities over the V known tokens and the
unknown one add up to 1.

The folder in spark.checkpoint.dir has to be a mounted file system. Files are written under a name of their own and
then moved into place, so a task that runs again does no harm.

Defined cases: a null text counts as empty and is its end alone; a null id counts as '' in the fold; without training
text the model is uniform over one token and all scores are 0; every row is scored, repeated ones too; very long texts
are counted and scored whole; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, WordHashes, ascii_words, mix, worker_task

END = b" end"  # no word holds a space
BYTES_A_SHARD = 12 << 20  # of text
MOST_SHARDS = 1 << 21  # beyond 25 TB of text a shard holds more than BYTES_A_SHARD
MOST_RANGES = 1 << 10  # of ids: a shard of pairs sends a row to each at most
TOKENS_A_FLUSH = 4_000_000
TOKENS_A_CHUNK = 500_000
CACHED_IDS = 400_000
HOT = 64  # candidates for spread contexts that a shard names

BLOB = "shard int, a binary, b binary"


def packed(array: np.ndarray) -> bytes:
    """A compressed array: bytes of equal weight stand together."""
    raw = np.ascontiguousarray(array)
    return raw.dtype.str.encode() + b":" + np.array([len(raw)], "<i8").tobytes() + pa.compress(raw.view(np.uint8).reshape(-1, raw.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    kind, rest = blob.split(b":", 1)
    kind, n = np.dtype(kind.decode()), int(np.frombuffer(rest[:8], "<i8")[0])
    raw = pa.decompress(rest[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=keys.dtype.type(0)))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def put_file(path: str, array: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        np.save(file, array)
    os.replace(own, path)


@lru_cache(maxsize=4096)
def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[bytes]], pa.RecordBatch]]:
    """Tokens of chunks of rows (text is the last column), about TOKENS_A_CHUNK at a time."""
    for batch in batches:
        start, found, n = 0, [], 0
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            found.append([*ascii_words(text.as_py()), END])
            n += len(found[-1])
            if n >= TOKENS_A_CHUNK:
                yield found, batch.slice(start, i + 1 - start)
                start, found, n = i + 1, [], 0
        if found:
            yield found, batch.slice(start)


def shards_out(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    names, first = np.unique(shard, return_index=True)
    ends = np.append(first[1:], len(shard))
    rows = [(int(s), packed_sorted(keys[a:b]), packed(narrow(counts[a:b]))) for s, a, b in zip(names, first, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "a", "b"])


def folded(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Adds up (keys, counts) until about TOKENS_A_FLUSH keys are there."""
    keys, counts, n = [], [], 0
    for k, c in pairs:
        keys.append(k)
        counts.append(c)
        n += len(k)
        if n >= TOKENS_A_FLUSH:
            yield added_up(keys, counts)
            keys, counts, n = [], [], 0
    if n:
        yield added_up(keys, counts)


@worker_task
def _words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def each():
        for texts, _ in pieces_of(batches):
            n = sum(map(len, texts))
            yield np.unique(np.fromiter((hashes[w] for t in texts for w in t), np.uint64, n), return_counts=True)

    for keys, counts in folded(each()):
        yield shards_out((keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32), keys, counts)


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys, counts = added_up([unpacked_sorted(x) for x in table.column("a").to_pylist()], [unpacked(x) for x in table.column("b").to_pylist()])
    return table.column("shard")[0].as_py(), keys, counts


def _write_words(table: pa.Table, folder: str) -> pa.Table:
    shard, keys, counts = _merged(table)
    put_file(f"{folder}/words/{shard}.keys.npy", keys)
    put_file(f"{folder}/words/{shard}.counts.npy", narrow(counts))
    hot = np.argsort(-counts, kind="stable")[:HOT]
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "hot": pa.array([hot.tolist()], pa.list_(pa.int64())), "hot_n": pa.array([counts[hot].tolist()], pa.list_(pa.int64()))})


class Layout:
    """What workers need besides the files: sizes and offsets, a few numbers a shard."""

    def __init__(self, folder: str, bits: int, rows: list):
        self.folder, self.bits, self.shards = folder, bits, 1 << bits
        sizes = np.zeros(self.shards, np.int64)
        for r in rows:
            sizes[r["shard"]] = r["n"]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.v, self.n = int(sizes.sum()), sum(r["total"] for r in rows)
        if self.v >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        least = self.n / (4 * self.shards)
        self.hot = np.array(sorted(int(self.offsets[r["shard"]]) + i + 1 for r in rows for i, c in zip(r["hot"], r["hot_n"], strict=True) if c > least), np.uint64)
        self.ranges = min(self.shards, MOST_RANGES)
        self.width = self.v // self.ranges + 1  # ids of a range
        self.discounts = self.unigram = None
        self.contexts = 0

    def shard_of_pair(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        spread = np.isin(context, self.hot)
        return (mix(np.where(spread, keys, context)) >> np.uint64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(keys), np.int32)


class WordIds(dict):
    """Ids of words (bytes); misses are looked up in the mapped arrays a chunk at a time."""

    def __init__(self, layout: Layout):
        super().__init__()
        self.layout, self.hashes = layout, WordHashes()

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        words = [w for t in texts for w in t]
        missing = [w for w in set(words) if w not in self]
        if len(self) + len(missing) > CACHED_IDS:
            self.clear()
            missing = list(set(words))
        if missing:
            hashes = np.fromiter((self.hashes[w] for w in missing), np.uint64, len(missing))
            ids = np.zeros(len(missing), np.int64)
            shard = (hashes >> np.uint64(64 - self.layout.bits)).astype(np.int64) if self.layout.bits else np.zeros(len(missing), np.int64)
            for s, at in by_shard(shard):
                path = f"{self.layout.folder}/words/{s}.keys.npy"
                if self.layout.offsets[s + 1] > self.layout.offsets[s]:
                    keys = mapped(path)
                    place = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
                    ids[at] = np.where(keys[place] == hashes[at], self.layout.offsets[s] + place + 1, 0)
            self.update(zip(missing, ids.tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    for s, at in zip(names, np.split(order, first[1:]), strict=True):
        yield int(s), at


def pair_keys(ids: np.ndarray, end_id: int) -> np.ndarray:
    """A 64-bit key for each token: the id before it, and its own. Texts are closed by their ends, so that before a first word is an end."""
    return (np.concatenate([np.array([end_id], np.uint64), ids[:-1]]) << np.uint64(32)) | ids


@worker_task
def _pairs(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    ids = WordIds(layout)
    end_id = int(ids.of([[END]])[0])

    def each():
        for texts, _ in pieces_of(batches):
            yield np.unique(pair_keys(ids.of(texts), end_id), return_counts=True)

    for keys, counts in folded(each()):
        yield shards_out(layout.shard_of_pair(keys), keys, counts)


def _write_pairs(table: pa.Table, layout: Layout) -> pa.Table:
    """Writes a shard; what its contexts and words add goes on, by ranges of ids. kind: 0 context, 1 word, 2 counts of counts."""
    shard, keys, counts = _merged(table)
    put_file(f"{layout.folder}/pairs/{shard}.keys.npy", keys)
    put_file(f"{layout.folder}/pairs/{shard}.counts.npy", narrow(counts))
    context = keys >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    sums = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)])
    words, continues = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
    rows = [(2, 0, b"", packed(np.array([(counts == i).sum() for i in (1, 2, 3, 4)] + [len(keys)], np.int64)))]
    for kind, names, values in ((0, context[first], sums), (1, words, continues[None, :])):
        edges = np.searchsorted(names, np.arange(0, layout.ranges + 1, dtype=np.uint64) * np.uint64(layout.width))
        for r in range(layout.ranges):
            a, b = edges[r], edges[r + 1]
            if b > a:
                rows.append((kind, r, packed_sorted(names[a:b]), packed(narrow(values[:, a:b].reshape(-1)))))
    columns = list(zip(*rows, strict=True))
    return pa.table({"kind": pa.array(columns[0], pa.int32()), "shard": pa.array(columns[1], pa.int32()), "a": pa.array(columns[2], pa.binary()), "b": pa.array(columns[3], pa.binary())})


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0) = 0, D(1), D(2), D(3 and more) from the numbers of keys that occur once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.1 * i), 0.95 * i) for i, d in enumerate(found, 1))])


def _write_ranges(table: pa.Table, layout: Layout) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    base = shard * layout.width
    total, gamma, continues = np.zeros(layout.width), np.zeros(layout.width, np.float32), np.zeros(layout.width, np.int64)
    mass = np.zeros(layout.width)
    for kind, a, b in zip(table.column("kind").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        at = (unpacked_sorted(a) - np.uint64(base)).astype(np.int64)
        values = unpacked(b)
        if kind == 0:
            values = values.reshape(4, -1).astype(float)
            total[at] += values[0]
            mass[at] += layout.discounts[1:] @ values[1:]
        else:
            continues[at] += values
    np.divide(mass, total, out=gamma, where=total > 0, casting="same_kind")
    for name, array in (("total", narrow(total.astype(np.int64))), ("gamma", gamma), ("continues", narrow(continues))):
        put_file(f"{layout.folder}/ranges/{shard}.{name}.npy", array)
    n = [int((continues == i).sum()) for i in (1, 2, 3, 4)] + [int((continues > 2).sum())]
    return pa.table({"n": pa.array([n], pa.list_(pa.int64()))})


def train(docs: DataFrame, work: Scratch, *, text_col: str) -> Layout:
    """Counts and writes the model of all rows of docs."""
    spark = docs.sparkSession
    folder = work.local("model")
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(int(np.log2(MOST_SHARDS)), int(np.ceil(np.log2(max(1, size / BYTES_A_SHARD)))))
    words = texts.mapInArrow(lambda it: _words(it, bits), BLOB).groupBy("shard")
    rows = words.applyInArrow(lambda t: _write_words(t, folder), "shard int, n bigint, total bigint, hot array<bigint>, hot_n array<bigint>").collect()  # a row a shard
    layout = Layout(folder, bits, rows)
    if not layout.v:
        return layout
    first = spark.sparkContext.broadcast(layout)
    pairs = texts.mapInArrow(lambda it: _pairs(it, first.value), BLOB).groupBy("shard")
    parts = work.put(pairs.applyInArrow(lambda t: _write_pairs(t, first.value), "kind int, shard int, a binary, b binary"), "parts")
    numbers = sum(unpacked(bytes(r["b"])) for r in parts.where("kind = 2").select("b").collect())  # five numbers a shard
    layout.discounts, layout.contexts = discounts(numbers), int(numbers[4])
    second = spark.sparkContext.broadcast(layout)
    ranges = parts.where("kind != 2").groupBy("shard").applyInArrow(lambda t: _write_ranges(t, second.value), "n array<bigint>").collect()
    n = np.sum([r["n"] for r in ranges], axis=0)
    e = discounts(n)
    layout.unigram = (e, float(e[1] * n[0] + e[2] * n[1] + e[3] * n[4]) / layout.contexts)
    return layout


class Model:
    def __init__(self, layout: Layout):
        self.layout = layout
        self.ids = WordIds(layout)
        self.end_id = int(self.ids.of([[END]])[0]) if layout.v else 0

    def range_values(self, ids: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(ids))
        for s, at in by_shard((ids // self.layout.width).astype(np.int64)):
            path = f"{self.layout.folder}/ranges/{s}.{name}.npy"
            if os.path.exists(path):
                out[at] = mapped(path)[(ids[at] - s * self.layout.width).astype(np.int64)]
        return out

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        known = np.flatnonzero(ids > 0)
        place = ids[known].astype(np.int64) - 1
        shard = np.searchsorted(self.layout.offsets, place, side="right") - 1
        for s, at in by_shard(shard):
            out[known[at]] = mapped(f"{self.layout.folder}/words/{s}.counts.npy")[place[at] - self.layout.offsets[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for s, at in by_shard(self.layout.shard_of_pair(keys)):
            path = f"{self.layout.folder}/pairs/{s}.keys.npy"
            if os.path.exists(path):
                there = mapped(path)
                place = np.minimum(np.searchsorted(there, keys[at]), len(there) - 1)
                out[at] = np.where(there[place] == keys[at], mapped(f"{self.layout.folder}/pairs/{s}.counts.npy")[place], 0)
        return out

    def log_probabilities(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its count in training, its base log10 and the model's log10 probability."""
        layout, n = self.layout, sum(map(len, texts))
        if not layout.v:
            return np.zeros(n), np.zeros(n), np.zeros(n)
        ids = self.ids.of(texts)
        distinct, inverse = np.unique(ids, return_inverse=True)
        counts = self.word_counts(distinct)
        base = np.log10((counts + 1) / (layout.n + layout.v + 1))
        k = self.range_values(distinct, "continues")
        e, rest = layout.unigram
        low = np.maximum(k - e[np.minimum(k, 3).astype(int)], 0) / layout.contexts + rest / (layout.v + 1)
        keys, key_inverse = np.unique(pair_keys(ids, self.end_id), return_inverse=True)
        c = self.pair_counts(keys)
        context = np.searchsorted(distinct, keys >> np.uint64(32))
        outside = distinct[np.minimum(context, len(distinct) - 1)] != keys >> np.uint64(32)  # the end as context of the first word of a chunk is always there
        total, gamma = self.range_values(distinct, "total"), self.range_values(distinct, "gamma")
        total, gamma = (np.where(outside, 0, x[np.minimum(context, len(distinct) - 1)]) for x in (total, gamma))
        own = np.maximum(c - layout.discounts[np.minimum(c, 3).astype(int)], 0)
        word = low[np.searchsorted(distinct, keys & np.uint64(0xFFFFFFFF))]
        p = np.where(total > 0, own / np.maximum(total, 1) + gamma * word, word)
        return counts[inverse], base[inverse], np.log10(p)[key_inverse]


@worker_task
def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = Model(shared.value)
    for texts, rows in pieces_of(batches):
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes) - sizes
        counts, base, score = model.log_probabilities(texts)
        sums = [np.add.reduceat(x, first) for x in (counts > 0, base, score)]
        columns = [*rows.columns[:-1], pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    layout = train(docs.where(fold != held), Scratch(docs.sparkSession, "lm"), text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (fold == held).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _scored(it, shared), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(layout.n).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
