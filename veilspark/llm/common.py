"""Helpers that the corpus operators share: scratch tables, word hashing, row access in Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CACHE = 300_000  # words whose hashes a worker keeps; the cache is emptied when it is full


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session may fall back to a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="veilspark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables of one run, written as Parquet in the shared folder; lost executors re-read them. Removed when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def put(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Writes df, in so many files at most, and returns it as read back: a cut of the lineage that outlives executors."""
        (df.coalesce(files) if files else df).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def local(self, name: str) -> str:
        """The path of a sub-folder as ordinary file calls take it; the shared folder has to be a mounted file system for that."""
        path = f"{self.path}/{name}"
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        elif "://" in path:
            raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a mounted file system, not {path}")
        return path


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """A broadcast hint only where a count has shown that the side stays under limit bytes; else Spark's shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


_kept: dict = {}  # in a Python worker: what the operator at work keeps from task to task, under one key


def kept_in_worker(key: tuple, make: Callable):
    """What make() gives, kept by the Python worker from task to task until another key is asked for: one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns what Python, Arrow and the C library hold without using it to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def worker_task(f: Callable) -> Callable:
    """For a function over an iterator of batches that a Python worker runs: workers live on from stage to stage, so a
    task begins without what other operators have kept there, and leaves no memory behind but what its own keeps."""

    @functools.wraps(f)
    def run(*args, **options) -> Iterator:
        if _kept and next(iter(_kept))[0] != f.__module__:
            _kept.clear()
        give_back()
        try:
            yield from f(*args, **options)
        finally:
            give_back()

    return run


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class WordHashes(dict):
    """Hashes of words (bytes), worked out once a word while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of anything but \\x20 and \\x09-\\x0D, A-Z lower-cased and nothing else (what bytes.lower and bytes.split do)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """One 64-bit hash for each position of a width-word shingle; a shorter text is one shingle, no words give none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, width)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * ODD[7] + mix(w[i : n - k + 1 + i] ^ ODD[i % 7]) + np.uint64(i)
    return mix(out + np.uint64(k))
