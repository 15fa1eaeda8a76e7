"""URL filters: rules first, then the likelihood ratio of two character models.

URLs that a rule decides are the examples: a smoothed variable-order Markov model over the bytes of accepted URLs and
one over rejected ones. Each mixes contexts of ORDER bytes down to none, P_k = (n(context, byte) + PRIOR * P_(k-1)) /
(n(context) + PRIOR), above a uniform model of 256 bytes. Counts come from all examples and are exact: a context and an
n-gram of up to ORDER + 1 bytes are a 64-bit number each, and their counts are folded by tasks, added up, and written
as sorted arrays to shards in the shared folder, whose number follows the examples. Workers map the arrays and look
numbers up by binary search; nothing of them goes through the driver. The score of a URL is the difference of its
log-likelihoods by byte; a logistic curve fitted to scores of examples that a model hasn't seen (a fifth of them, by
hash) turns it into a probability. spark.checkpoint.dir has to be a mounted file system, as for LM scoring.

Defined cases: a null URL and one without '://' have an empty host and path, no rule, and are judged by their bytes (a
null as empty, score 0); without examples of both kinds every open URL is allowed; very long URLs are scored whole;
where two rules of equal length fit, the later one in order of their text wins; every row is answered on its own, so
repeated rows and ids and null ids don't matter; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, fresh, mix, worker_task
from veilspark.llm.lm_score import by_shard, mapped, put_file

ORDER = 4
PRIOR = 4.0
FOLDS = 5
BINS = 400  # of the scores' histogram, from -EDGE to EDGE
EDGE = 4.0
BATCH = 4000
BYTES_A_SHARD = 16 << 20  # of URLs that are examples
FLUSH = 2_000_000  # distinct numbers that a task holds before it sends them
KINDS = ((0, 0), (0, 1), (1, 0), (1, 1))  # columns of counts: model (1: accepted) and fold (1: held back for the curve)

Rule = tuple[str, str, str]  # host, path, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    known = url.isNotNull() & (at > 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def contexts(urls: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Row of each byte, and for each order the numbers of (context, byte) and of the context."""
    pad = b"\0" * ORDER
    stream = np.frombuffer(b"".join(pad + u for u in urls), np.uint8).astype(np.uint64)
    sizes = np.array([len(u) for u in urls])
    row = np.repeat(np.arange(len(urls)), sizes)
    begin = np.cumsum(sizes + ORDER) - sizes
    at = np.arange(len(row)) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(row) else np.empty(0, np.int64)
    grams, above = [], []
    context = np.zeros(len(row), np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = context | (stream[at - k] << np.uint64(8 * (k - 1)))
        # order, whether a byte follows, the byte, the context: different bits of the number
        above.append(context | np.uint64(k << 56))
        grams.append(context | (stream[at] << np.uint64(8 * ORDER)) | np.uint64(k << 56 | 1 << 48))
    return row, grams, above, sizes


class Counts:
    """Exact counts of numbers under a choice of models and folds, from sorted arrays in files."""

    def __init__(self, folder: str, bits: int, columns: tuple[int, ...]):
        self.folder, self.bits, self.columns = folder, bits, list(columns)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers))
        for s, at in by_shard(shard_of(numbers, self.bits)):
            try:
                keys, counts = mapped(f"{self.folder}/{s}.keys.npy"), mapped(f"{self.folder}/{s}.counts.npy")
            except FileNotFoundError:  # no example has a number of this shard
                continue
            place = np.minimum(np.searchsorted(keys, numbers[at]), len(keys) - 1)
            out[at] = np.where(keys[place] == numbers[at], counts[self.columns][:, place].sum(axis=0), 0)
        return out


def shard_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (mix(numbers) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(numbers), np.int64)


def log_likelihood(urls: list[bytes], counts) -> np.ndarray:
    """Natural log-likelihood of each URL; counts gives the counts of an array of numbers."""
    row, grams, above, _ = contexts(urls)
    distinct, places = np.unique(np.concatenate([*grams, *above]), return_inverse=True)
    found = counts(distinct)[places].reshape(2, ORDER + 1, len(row))
    p = np.full(len(row), 1 / 256)
    for g, c in zip(*found, strict=True):
        p = (g + PRIOR * p) / (c + PRIOR)
    return np.bincount(row, weights=np.log(p), minlength=len(urls))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


@worker_task
def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(url, model, fold) -> (shard, keys, counts): the numbers of a task are added up before they leave it; counts has a column for each of KINDS."""
    held, size = [[] for _ in KINDS], 0

    def out() -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate([k for x in held for k, _ in x]))
        table = np.zeros((len(KINDS), len(keys)), np.int64)
        for column, x in zip(table, held, strict=True):
            for k, n in x:
                column[np.searchsorted(keys, k)] += n
        rows = [(s, keys[at].tobytes(), table[:, at].tobytes()) for s, at in by_shard(shard_of(keys, bits))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])

    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            urls, model, fold = _bytes(part.column(0)), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
            row, grams, above, _ = contexts(urls)
            for k, (m, f) in enumerate(KINDS):
                here = ((model == m) & (fold == f))[row]
                if here.any():
                    held[k].append(np.unique(np.concatenate([x[here] for x in (*grams, *above)]), return_counts=True))
                    size += len(held[k][-1][0])
            if size >= FLUSH:
                yield from out()
                held, size = [[] for _ in KINDS], 0
    if size:
        yield from out()


def _write_shard(table: pa.Table, folder: str) -> pa.Table:
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    counts = [np.frombuffer(x.as_py(), np.int64).reshape(len(KINDS), -1) for x in table.column("counts")]
    distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((len(KINDS), len(distinct)), np.int64)
    for column, x in zip(sums, np.concatenate(counts, axis=1), strict=True):
        np.add.at(column, places, x)
    shard = table.column("shard")[0].as_py()
    put_file(f"{folder}/{shard}.keys.npy", distinct)
    put_file(f"{folder}/{shard}.counts.npy", sums)
    return pa.table({"shard": pa.array([shard], pa.int32()), "rejected": pa.array([int(sums[:2].sum())], pa.int64()), "accepted": pa.array([int(sums[2:].sum())], pa.int64())})


@worker_task
def _scored(batches: Iterator[pa.RecordBatch], accepted: Counts, rejected: Counts) -> Iterator[pa.RecordBatch]:
    """Appends score: the difference of log-likelihoods by byte."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            urls = _bytes(part.column("url"))
            size = np.maximum([len(u) for u in urls], 1)
            score = (log_likelihood(urls, accepted) - log_likelihood(urls, rejected)) / size
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])
    mapped.cache_clear()


def logistic(score: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through counts of accepted and rejected at each score, with one added example of either kind."""
    x = np.concatenate([score, [0.5, -0.5]])
    yes, no = np.concatenate([accepted, [1, 0]]).astype(float), np.concatenate([rejected, [0, 1]]).astype(float)
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (yes - (yes + no) * p) - 1e-3 * w
        step = np.linalg.solve((design * ((yes + no) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def trained(labelled: DataFrame, work: Scratch) -> tuple[Counts, Counts, float, float] | None:
    """Counts of either model and the curve from (url, accepted 0/1); None without examples of both kinds."""
    folder = work.local("counts")
    rows = labelled.select("url", F.col("accepted").cast("int").alias("model"), (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).cast("int").alias("fold"))
    size = rows.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(1, size / BYTES_A_SHARD))))
    sums = rows.mapInArrow(lambda it: _counted(it, bits), "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(lambda t: _write_shard(t, folder), "shard int, rejected bigint, accepted bigint")
    found = sums.agg(F.sum("rejected"), F.sum("accepted")).first()  # writes the arrays
    if not found[0] or not found[1]:
        return None
    at = {kind: k for k, kind in enumerate(KINDS)}
    seen = Counts(folder, bits, (at[1, 0],)), Counts(folder, bits, (at[0, 0],))
    held = rows.where("fold = 1").select("url", "model").mapInArrow(lambda it: _scored(it, *seen), "url string, model int, score double")
    place = F.floor((F.greatest(F.least("score", F.lit(EDGE - 1e-9)), F.lit(-EDGE)) + EDGE) * (BINS / (2 * EDGE))).cast("int")
    bins = held.groupBy(place.alias("bin"), "model").agg(F.count("*").alias("n")).collect()  # at most 2 * BINS rows
    counts = np.zeros((2, BINS))
    for r in bins:
        counts[r["model"], r["bin"]] = r["n"]
    slope, offset = logistic((np.arange(BINS) + 0.5) * (2 * EDGE / BINS) - EDGE, counts[1], counts[0])
    return Counts(folder, bits, (at[1, 0], at[1, 1])), Counts(folder, bits, (at[0, 0], at[0, 1])), slope, offset


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict (allow or block), score and p_allow (the model's)."""
    work = Scratch(pages.sparkSession, "url-filter")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("decided", decided)
    model = trained(rows.where("decided is not null").select("url", (F.col("decided") == "allow").alias("accepted")), work)
    if model is None:
        out = rows.withColumn("score", F.lit(0.0)).withColumn("p_allow", F.lit(1.0))
    else:
        accepted, rejected, slope, offset = model
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        out = rows.mapInArrow(lambda it: _scored(it, accepted, rejected), f"{kinds}, score double")
        out = out.withColumn("p_allow", 1 / (1 + F.exp(-(F.col("score") * slope + offset))))
    verdict = F.coalesce("decided", F.when(F.col("p_allow") >= threshold, "allow").otherwise("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", "p_allow")


def keep_allowed(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The pages whose URLs are allowed, with their columns."""
    allowed = fresh("_allowed", pages.columns)
    verdict = judge(pages, rules, id_col=id_col, url_col=url_col).where("verdict = 'allow'").select(F.col(id_col).alias(allowed)).distinct()
    return pages.join(verdict, F.col(id_col).eqNullSafe(F.col(allowed)), "left_semi")
