"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Workers tokenize whole texts, cut only what is longer than a sequence, and write (id, piece, start, length, crc32).
The histogram of lengths has at most `capacity` rows, so it goes to the driver whatever the size of the corpus. There,
the program "cover every length's count by configurations of a sequence" is solved by multiplicative weights: a weight
for each length falls as it gets covered, and the configuration that is worth most under the weights comes from a
bounded knapsack dynamic program over 1..capacity. A round uses it a whole number of times, so rounding leaves nothing
over but the lengths that can't fill a sequence any more (REST of the pieces at least); these are placed by best fit in
decreasing length, also into the gaps of the configurations. The dual of the program gives a lower bound on the number
of sequences; plain best fit is kept as a bound from above.

A plan is a list of configurations with how often each is used, so its size depends on the number of lengths, not of
documents. Pieces get their place by their rank among pieces of their length; a length with many pieces is ranked in
salted groups of about ROWS_A_GROUP, so one that a third of all pieces has is spread over many tasks.

Defined cases: a null text counts as empty and is the single end id; rows that repeat an id are packed each; a null id
is packed under null; very long texts are cut into as many pieces as they need; pieces of equal length are placed in
order of (id, piece, crc32), rows that tie in all three in any order; an empty table gives an empty result; other
columns may have any names, they are neither read nor returned.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, kept_in_worker, worker_task
from veilspark.llm.token_count import BYTE_CHARACTERS, tokenizer

CAPACITY = 4096
END_ID = 1
BLOCK = 32  # lengths that a round prices, more where these can't fill a sequence
MOST_BLOCK = 384
RATE = 0.0005  # how fast a weight falls with coverage: differences of worth that outweigh as much room in a sequence
MOST_OPEN = 1 / 16  # share of a sequence that a configuration may leave open in the end
REST = 0.05  # share of pieces that is left to best fit, half of it the shortest
TRIES = 3
CACHED_BYTES = 96 << 20  # of distinct words and their ids that a worker remembers, and half as much of parts; emptied when full
ENTRY = 180  # bytes of an entry besides its characters and ids
LONG_WORD = 256
ROWS_A_GROUP = 2000  # pieces of one length that are ranked together

Config = tuple[tuple[int, int], ...]  # (length, times), longest first


# words whose parts are certain: printable ASCII but the apostrophe and what could open an added token, and Latin letters
SIMPLE = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class WordIds(dict):
    """The ids of a run of characters other than space and line feed, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and none of its tokens crosses it, so a text's ids are its words' ids in a row. A
    simple word is its parts (letters, single digits, signs) in a row, which the tokenizer's model merges each on its
    own after lower-casing; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encode, self.merge, self.parts, self.held, self.parts_held = tokenizer(path).encode, tokenizer(path).model.tokenize, {}, 0, 0

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = np.array([x.id for x in self.merge("".join(BYTE_CHARACTERS[b] for b in text.encode()))], "<u4").tobytes()
            self.parts_held += ENTRY + 2 * len(text) + len(found)
            if self.parts_held > CACHED_BYTES // 2:
                self.parts.clear()
                self.parts_held = 0
            if len(text) <= LONG_WORD:
                self.parts[text] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word):
            found = b"".join(map(self.part, PARTS.findall(word.lower())))
        else:
            found = np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONG_WORD:
            self.held += ENTRY + 2 * len(word) + len(found)
            if self.held > CACHED_BYTES:
                self.clear()
                self.held = 0
            self[word] = found
        return found


def remembered(path: str) -> WordIds:
    """Kept by the worker from task to task of this operator."""
    return kept_in_worker((__name__, path), lambda: WordIds(path))


def token_bytes(text: str, words: WordIds) -> bytes:
    return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))


@worker_task
def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words, end, size = remembered(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).slice(at, 2000)):
                ids = token_bytes(text.as_py() or "", words) + end
                for k, begin in enumerate(range(0, len(ids), size)):
                    part = ids[begin : begin + size]
                    row.append(at + i)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])


@lru_cache(maxsize=1)
def _index(capacity: int) -> np.ndarray:
    return np.arange(capacity + 1)


def best_configuration(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> Config:
    """The multiset of lengths of the greatest worth that fits: an unbounded knapsack by dynamic programming over capacities."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, _index(capacity), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        values = best[c - lengths[: reach[c]]] + worth[: reach[c]]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], took[c] = values[k], k
        else:
            best[c] = best[c - 1]
    times: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        times[int(lengths[took[c]])] += 1
        c -= int(lengths[took[c]])
    return tuple(sorted(times.items(), reverse=True))


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: with a worth for each length, all pieces are worth so many best configurations (the dual of the program)."""
    lengths = np.array(sorted(histogram))
    best = sum(x * k for x, k in best_configuration(lengths, lengths / capacity, capacity))
    return max(-(-sum(x * n for x, n in histogram.items()) // best), sum(n for x, n in histogram.items() if 2 * x > capacity))


def priced(lengths: np.ndarray, most: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration (place of a length: times) of the greatest worth that holds each length at most `most` times: a bounded knapsack by dynamic programming over capacities."""
    items = []  # (place, times): times are powers of two and a rest, so that every number up to most can be made
    for i, m in enumerate(most.tolist()):
        times = 1
        while m > 0:
            items.append((i, min(times, m)))
            m -= times
            times *= 2
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for row, (i, times) in zip(took, items, strict=True):
        size = times * int(lengths[i])
        with_it = best[: capacity + 1 - size] + times * worth[i]
        np.greater(with_it, best[size:] + 1e-12, out=row[size:])
        np.copyto(best[size:], with_it, where=row[size:])
    found: dict[int, int] = defaultdict(int)
    c = int(best.argmax())
    for row, (i, times) in zip(took[::-1], reversed(items), strict=True):
        if row[c]:
            found[i] += times
            c -= times * int(lengths[i])
    return found


def set_aside(histogram: dict[int, int], share: float) -> dict[int, int]:
    """The shortest pieces, a share of all: best fit closes gaps with them at the end."""
    room, found = int(share * sum(histogram.values())), {}
    for x in sorted(histogram):
        if room > 0:
            found[x] = min(histogram[x], room)
            room -= found[x]
    return found


def program(histogram: dict[int, int], capacity: int, *, rest: float = REST, seed: int = 1) -> tuple[dict[Config, int], dict[int, int]]:
    """(configurations and how often each is used, what is left): multiplicative weights on the covering program, rounded as it goes.

    A length's worth is its share of a sequence times a weight that falls with the share of its pieces that are covered
    and rises a little with its size, as large pieces are hard to place late. A round draws a block of lengths by their
    open pieces, prices the best configuration among them, and uses it as often as its scarcest length allows, a whole
    number of times. A configuration has to fill its sequence to the last token: where the best doesn't, the bare shares
    are the worths of the next round, then the block grows, and where MOST_BLOCK lengths can't fill one either, a larger
    part of a sequence may stay open, up to MOST_OPEN. The program ends there, or where a share of `rest` is left.
    """
    draw = np.random.default_rng(seed)
    aside = set_aside(histogram, rest / 2)
    lengths = np.array(sorted(histogram, reverse=True))
    there = np.array([histogram[x] - aside.get(x, 0) for x in lengths.tolist()])
    left, used = there.copy(), defaultdict(int)
    size, heat, open_part = BLOCK, RATE, 0.0
    while left.sum() > rest / 2 * sum(histogram.values()):
        open_ = np.flatnonzero(left)
        block = open_ if len(open_) <= size else np.sort(draw.choice(open_, size, replace=False, p=left[open_] / left.sum()))
        part = lengths[block] / capacity
        worth = part * np.exp(heat * (left[block] / there[block] - 1)) * part**heat
        times = {int(block[i]): k for i, k in priced(lengths[block], np.minimum(left[block], capacity // lengths[block]), worth, capacity).items()}
        if sum(int(lengths[i]) * k for i, k in times.items()) < capacity * (1 - open_part):
            if heat:
                heat = 0.0
            elif size < min(MOST_BLOCK, len(open_)):
                size *= 2
            elif open_part < MOST_OPEN:
                open_part = max(1 / 1024, 2 * open_part)
            else:
                break
            continue
        n = min(int(left[i]) // k for i, k in times.items())
        for i, k in times.items():
            left[i] -= n * k
        used[tuple((int(lengths[i]), k) for i, k in sorted(times.items()))] += n
        size, heat = max(BLOCK, size // 2), RATE
    remaining = {int(x): int(n) + aside.get(int(x), 0) for x, n in zip(lengths, left, strict=True)}
    return used, {x: n for x, n in remaining.items() if n}


def best_fit(histogram: dict[int, int], capacity: int, begun: list[tuple[Config, int]] = ()) -> list[tuple[Config, int]]:
    """Best fit in decreasing length over a histogram; whole groups of equal sequences are filled at once, those begun too."""
    groups: dict[int, list[tuple[Config, int]]] = defaultdict(list)
    for config, n in begun:
        groups[capacity - sum(x * k for x, k in config)].append((config, n))
    gaps = sorted(groups)

    def put(gap: int, config: Config, n: int) -> None:
        if gap not in groups or not groups[gap]:
            bisect.insort(gaps, gap)
        groups[gap].append((config, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    put(capacity - per * length, ((length, per),), whole)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            gap = gaps[at]
            config, n = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(at)
            fits = min(gap // length, max(1, left // n) if left >= n else left)  # as best fit would: the same sequence until it is full
            filled = min(n, left // fits)
            if filled < n:
                put(gap, config, n - filled)
            put(gap - fits * length, (*config, (length, fits)), filled)
            left -= fits * filled
    return [(config, n) for rows in groups.values() for config, n in rows]


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Config, int]], float]:
    """Configurations and how often each is used, over all pieces, and the share of pieces that the program has placed.

    Best fit places what the program leaves, also into its gaps. The program is run anew with other draws, up to TRIES
    times, while its plan has more sequences than the lower bound and than plain best fit; at last the plan with the
    fewest sequences is used, plain best fit (share 0) only where it has fewer than all others.
    """
    if not histogram:
        return [], 0.0
    plain = best_fit(histogram, capacity)
    count = lambda configs: sum(n for _, n in configs)
    enough = max(lower_bound(histogram, capacity), count(plain))
    found = []
    for seed in range(1, TRIES + 1):
        used, left = program(histogram, capacity, seed=seed)
        found.append((best_fit(left, capacity, list(used.items())), 1 - sum(left.values()) / sum(histogram.values())))
        if count(found[-1][0]) <= enough:
            break
    return min([*found, (plain, 0.0)], key=lambda x: count(x[0]))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    return planned(histogram, capacity)[0]


def slots(configs: list[tuple[Config, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces of a length take the slots in the order of their ranks."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, n in configs:
        offset = 0
        for length, k in config:
            for _ in range(k):
                rows.append((length, rank[length], sequence, offset))
                rank[length] += n
                offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


@worker_task
def _placed(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    length, first, sequence, offset = table.value.T
    keys = (length << 44) + first
    for batch in batches:
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (batch.column("length").to_numpy(zero_copy_only=False) << 44) + rank, side="right") - 1
        columns = [*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for every piece of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _cut(it, tokenizer_path, capacity, end_id), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    work = Scratch(spark, "packing")
    cut = work.put(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    salts = spark.createDataFrame([(x, -(-n // ROWS_A_GROUP)) for x, n in histogram.items()], "length bigint, salts bigint")  # at most `capacity` rows
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("row") - 1 + F.col("before"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda it: _placed(it, table), schema)
    return placed.withColumnRenamed("id", id_col)
