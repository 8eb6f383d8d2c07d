"""Helpers shared by the corpus operators: table access, Arrow stages, word
hashing, and intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; texts are long, so batches are kept short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _released(fn: Callable, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``fn`` yields for the batches in slices. A worker outlives its task and serves the next
    stages, so memos (cycles with what fills them) are let go where the task ends."""

    def sliced():
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                yield b.slice(at, BATCH_ROWS)

    try:
        yield from fn(sliced())
    finally:
        word_hash.clear()
        gc.collect()


def arrow_stage(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose input batches are at most BATCH_ROWS rows; ``fn`` sees
    them in slices, so that what it builds per batch stays small as well."""

    def run(batches):
        yield from _released(fn, batches)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the session names. Without
    that setting (tests, local runs) the session's warehouse serves, and is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Removes the shuffle files of a statement when it ends: a saved table needs none of them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Intermediate tables of one operator run, written as Parquet to the shared
    folder: lineage ends there, and a lost executor costs only its own tasks."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dir, self.n = spark, shared_dir(spark), 0
        self.held: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.dir}/{self.n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((saved, path))
        return saved

    def drop(self, *saved: DataFrame | None) -> None:
        """Deletes saved tables that no later step reads."""
        for df, path in [x for x in self.held if any(x[0] is y for y in saved)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.held = [x for x in self.held if not any(x[0] is y for y in saved)]


class Memo(dict):
    """A bounded memo: cleared when full, so a worker's memory has a bound."""

    def __init__(self, compute: Callable, limit: int = 400_000) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


#: Words as `[^\x20\x09-\x0D]+`: bytes.split() cuts at exactly these six bytes, and
#: bytes.lower() lower-cases exactly A-Z.
word_hash = Memo(xxhash.xxh3_64_intdigest)
_K = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: list[bytes], size: int = 5) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` words, in order; fewer words are one window."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(word_hash.__getitem__, words), np.uint64, n)
    k = min(n, size)
    h = a[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        h = h * _K + a[i : n - k + 1 + i]
    return mix64(h)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
