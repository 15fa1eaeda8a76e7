"""Token counts from pre-token frequencies: pieces are counted once per distinct pre-token of the corpus, joined to each
document's pre-token frequencies and summed; no document's ids are ever built.

A pre-token here is a run of white space with the run of other characters after it, or the string of an added token. A
byte-level BPE never merges across the start of such a run, so the pieces of a text are the pieces of its pre-tokens.
Only next to a sign that libraries don't agree on as white space (DOUBTFUL) a pre-token goes on to the end of the next
run.

1. Every task folds its texts into a set of distinct pre-tokens and sends them, in compressed blocks, to the shard that
   their hash belongs to. A shard drops what several tasks have sent, counts the pieces of each pre-token once, and
   writes (128-bit hash, pieces) as sorted arrays to the shared folder. The number of shards follows the corpus.
2. Every task builds (document, pre-token, frequency) for a few documents at a time, joins the distinct pre-tokens with
   the arrays by binary search in the mapped files, and sums by document: the documents' pairs aren't shuffled, which
   would move more bytes than the texts have.

Where the shared folder is no mounted file system the same is done by a join of DataFrames (`mapped=False`): pairs,
distinct pre-tokens, counts, join, sum; each pre-token's pairs are folded by document first.

Defined cases: a null text counts as empty and has 0 bytes and 0 tokens; very long texts and very long pre-tokens are
counted whole; every row is answered on its own, so repeated rows, ties and null ids don't matter; other columns may
have any names, they are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, kept_in_worker, worker_task
from veilspark.llm.lm_score import by_shard, mapped, put_file

OVER_LIMIT = 512
CACHED = 400_000  # distinct parts that a worker remembers; emptied when full
LONG_PRETOKEN = 256  # longer ones aren't remembered
BATCH_CHARS = 4_000_000  # texts of about this many characters are joined at a time
BYTES_A_SHARD = 24 << 20  # of text
FLUSH = 1_000_000  # distinct pre-tokens that a task holds before it sends them

# fixed values: what every library takes for white space, and what only some do
SPACE = " \t\n\x0b\x0c\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBTFUL = "\x1c-\x1f\x85\u180e\u200b\ufeff"
PRETOKEN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
ANY_DOUBT = re.compile(f"[{DOUBTFUL}]")
GLUED = re.compile(f"[{SPACE}]*+(?:[^{SPACE}{DOUBTFUL}]*+[{DOUBTFUL}][{SPACE}{DOUBTFUL}]*+)++[^{SPACE}{DOUBTFUL}]*+|[{SPACE}]*+[^{SPACE}{DOUBTFUL}]++|[{SPACE}]++")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_characters() -> list[str]:
    """The character by which a byte-level BPE writes each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()
# pre-tokens whose parts are certain: printable ASCII but the apostrophe, and Latin letters; after at most one space
SIMPLE = re.compile(r" ?[!-&(-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")


class PieceCounts(dict):
    """Pieces of pre-tokens as the tokenizer counts them, remembered up to a bound.

    A simple pre-token is the sum of its parts (letters, digits, signs), which the tokenizer's model merges each on its
    own; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encode, self.merge, self.added = tokenizer(path).encode, tokenizer(path).model.tokenize, added_strings(path)

    def __missing__(self, part: str) -> int:
        found = len(self.merge("".join(BYTE_CHARACTERS[b] for b in part.encode())))
        if len(part) <= LONG_PRETOKEN:
            if len(self) >= CACHED:
                self.clear()
            self[part] = found
        return found

    def pieces(self, pretoken: str) -> int:
        if SIMPLE.fullmatch(pretoken) and not (self.added and self.added.search(pretoken)):
            return sum(map(self.__getitem__, PARTS.findall(pretoken)))
        return len(self.encode(pretoken, add_special_tokens=False).ids)

    def of(self, pretokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.pieces, pretokens), np.int64, len(pretokens))


class Dictionary:
    """Pieces of pre-tokens by their hash, from sorted arrays in files."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def of(self, pretokens: list[str]) -> np.ndarray:
        out = np.zeros(len(pretokens), np.int64)
        high, low = hashes(pretokens)
        for s, at in by_shard(shards(high, self.bits)):
            keys, rest, pieces = (mapped(f"{self.folder}/{s}.{x}.npy") for x in ("high", "low", "pieces"))
            place = np.searchsorted(keys, high[at])
            for _ in range(64):  # two pre-tokens may share the upper half of the hash
                wrong = rest[place] != low[at]
                if not wrong.any():
                    break
                place = place + wrong
            out[at] = pieces[place]
        return out


def hashes(pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in pretokens]), ">u8").reshape(-1, 2)
    return digests[:, 0].astype(np.uint64), digests[:, 1].astype(np.uint64)


def shards(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)


def added_strings(path: str) -> re.Pattern | None:
    """A pattern of the strings of added tokens; None where there are none."""
    found = sorted((x.content for x in tokenizer(path).get_added_tokens_decoder().values()), key=lambda x: (-len(x), x))
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def plain_added(path: str) -> bool:
    """Whether added tokens match their strings and nothing else."""
    return not any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in tokenizer(path).get_added_tokens_decoder().values())


def pretokens(text: str, added: re.Pattern | None, plain: bool = True) -> list[str]:
    """The text cut into pre-tokens; nothing is left out."""
    if added and added.search(text):
        if not plain:
            return [text]  # added tokens that take what is around them: the text is one pre-token
        return [x for k, part in enumerate(added.split(text)) for x in ([part] if k % 2 else pretokens(part, None))]
    return (GLUED if ANY_DOUBT.search(text) else PRETOKEN).findall(text)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def frequencies(texts: list[str], added: re.Pattern | None, plain: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their number for each occurrence, occurrences of each text)."""
    numbers: dict[str, int] = {}
    rows, lengths = [np.empty(0, np.int32)], []
    for text in texts:
        found = pretokens(text, added, plain)
        rows.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in found), np.int32, len(found)))
        lengths.append(len(found))
    return list(numbers), np.concatenate(rows), np.array(lengths, np.int64)


def count_batch(texts: list[str], counts: PieceCounts | Dictionary, added: re.Pattern | None, plain: bool = True) -> np.ndarray:
    """Tokens of each text: its pre-tokens' numbers, joined with the pieces of the distinct ones, summed."""
    names, numbers, lengths = frequencies(texts, added, plain)
    each = counts.of(names)[numbers]
    return np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=each, minlength=len(texts)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Texts (the last column, null as empty) of about BATCH_CHARS characters at a time, with their rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = [x or "" for x in part.column(part.num_columns - 1).to_pylist()]
            for start, end in _groups(texts):
                yield texts[start:end], part.slice(start, end - start)


@worker_task
def _distinct(batches: Iterator[pa.RecordBatch], path: str, bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, compressed block of distinct pre-tokens, its size) of the task's texts."""
    added, plain, seen = added_strings(path), plain_added(path), set()

    def out() -> pa.RecordBatch:
        names = list(seen)
        rows = []
        for s, at in by_shard(shards(hashes(names)[0], bits)):
            block = b"".join(len(x).to_bytes(4, "little") + x for x in (names[i].encode("utf-8", "surrogatepass") for i in at))
            rows.append((s, pa.compress(block, codec="zstd", asbytes=True), len(block)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["shard", "block", "size"])

    for texts, _ in _texts(batches):
        for text in texts:
            seen.update(pretokens(text, added, plain))
        if len(seen) >= FLUSH:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _unpacked(block: bytes, size: int) -> Iterator[str]:
    block, at = pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True), 0
    while at < size:
        n = int.from_bytes(block[at : at + 4], "little")
        yield block[at + 4 : at + 4 + n].decode("utf-8", "surrogatepass")
        at += 4 + n


def _write_shard(table: pa.Table, path: str, folder: str) -> pa.Table:
    """Counts each pre-token of a shard once and writes the shard's arrays, under a name of their own first."""
    shard, names = table.column("shard")[0].as_py(), set()
    for block, size in zip(table.column("block"), table.column("size"), strict=True):
        names.update(_unpacked(block.as_py(), size.as_py()))
    names = list(names)
    counts = kept_in_worker((__name__, path), lambda: PieceCounts(path))
    pieces, (high, low) = counts.of(names), hashes(names)
    order = np.lexsort((low, high))
    small = np.uint16 if pieces.max() < 1 << 16 else np.int64
    for name, array in (("high", high[order]), ("low", low[order]), ("pieces", pieces[order].astype(small))):
        put_file(f"{folder}/{shard}.{name}.npy", array)
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(names)], pa.int64())})


@worker_task
def _counted(batches: Iterator[pa.RecordBatch], path: str, folder: str, bits: int) -> Iterator[pa.RecordBatch]:
    added, plain, counts = added_strings(path), plain_added(path), Dictionary(folder, bits)
    for texts, rows in _texts(batches):
        sizes = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column(0), sizes, pa.array(count_batch(texts, counts, added, plain))], ["id", "n_bytes", "n_tokens"])
    mapped.cache_clear()


@worker_task
def _pairs(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """For each row a number of its own with its id and n_bytes (pre-token null), and its pre-tokens with their frequencies."""
    added, plain, row = added_strings(path), plain_added(path), TaskContext.get().partitionId() << 40
    for texts, rows in _texts(batches):
        names, numbers, lengths = frequencies(texts, added, plain)
        pair, n = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(names) + numbers, return_counts=True)
        none = pa.nulls(len(pair), rows.column(0).type)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([row + np.arange(len(texts)), row + pair // max(len(names), 1)])), pa.concat_arrays([rows.column(0), none]), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts] + n.tolist(), pa.int64()), pa.concat_arrays([pa.nulls(len(texts), pa.string()), pa.array(names, pa.string()).take(pa.array(pair % max(len(names), 1)))])], ["row", "id", "n", "pretoken"])
        row += len(texts)


@worker_task
def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counts = kept_in_worker((__name__, path), lambda: PieceCounts(path))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.of(batch.column(0).to_pylist()))], ["pretoken", "pieces"])


def _joined(rows: DataFrame, work: Scratch, path: str, kind: str) -> DataFrame:
    """(id, n_bytes, n_tokens) by a join of DataFrames."""
    pairs = work.put(rows.mapInArrow(lambda it: _pairs(it, path), f"row bigint, id {kind}, n bigint, pretoken string"), "pairs")
    inside = pairs.where("pretoken is not null")
    pieces = work.put(inside.select("pretoken").distinct().mapInArrow(lambda it: _pieces(it, path), "pretoken string, pieces bigint"), "pieces")
    sums = inside.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tokens"))
    return pairs.where("pretoken is null").select("row", "id", F.col("n").alias("n_bytes")).join(sums, "row", "left").select("id", "n_bytes", F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER_LIMIT, mapped: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    work = Scratch(docs.sparkSession, "token-counts")
    if mapped:
        folder = work.local("dictionary")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = int(np.ceil(np.log2(max(1, size / BYTES_A_SHARD))))
        blocks = rows.select("text").mapInArrow(lambda it: _distinct(it, tokenizer_path, bits), "shard int, block binary, size bigint")
        blocks.groupBy("shard").applyInArrow(lambda t: _write_shard(t, tokenizer_path, folder), "shard int, n bigint").agg(F.sum("n")).first()  # writes the arrays
        found = rows.mapInArrow(lambda it: _counted(it, tokenizer_path, folder, bits), f"id {kind}, n_bytes bigint, n_tokens bigint")
    else:
        found = _joined(rows, work, tokenizer_path, kind)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
