"""Exactly-once append tables for `foreachBatch`.

Each batch writes its rows to a path of its own, named by the batch id; one mark, written last,
commits all tables of the batch. A retry overwrites its own files, a replay of a committed batch
writes nothing, and readers see committed batches only. `compact` folds the committed batches
into one and commits that by a mark of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class BatchLog:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], partition_by: dict[str, list[str]] | None = None) -> None:
        """`tables`: name -> schema as DDL; `partition_by`: name -> columns of the folder tree."""
        self.spark, self.path, self.tables, self.partition_by = spark, path.rstrip("/"), tables, partition_by or {}

    def _at(self, name: str):
        """The file system that holds a path of the log, and the path in its terms."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def committed(self) -> list[str]:
        """Committed parts in force: the newest fold (c...) and the batches (b...) after it."""
        marks = self._names("commits")
        fold = max((m for m in marks if m[0] == "c"), default=None)
        batches = [m for m in marks if m[0] == "b" and (fold is None or m[1:] > fold[1:])]
        return ([fold] if fold else []) + batches

    def last_batch(self) -> int | None:
        return max((int(p[1:]) for p in self.committed()), default=None)

    def read(self, name: str) -> DataFrame:
        """All committed rows of a table."""
        parts = self.committed()
        return self._read(name, parts) if parts else self.spark.createDataFrame([], self.tables[name])

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        root = f"{self.path}/{name}"
        return self.spark.read.schema(self.tables[name]).option("basePath", root).parquet(*[f"{root}/batch={p}" for p in parts]).drop("batch")

    def write(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """The batch's rows of a table, not committed yet; returns what was written."""
        return self._write(name, rows, f"b{batch_id:012d}")

    def _write(self, name: str, rows: DataFrame, part: str) -> DataFrame:
        rows.write.mode("overwrite").partitionBy(*self.partition_by.get(name, [])).parquet(f"{self.path}/{name}/batch={part}")
        return self._read(name, [part])

    def commit(self, batch_id: int, kind: str = "b") -> None:
        fs, mark = self._at(f"commits/{kind}{batch_id:012d}")
        fs.create(mark, True).close()

    def compact(self, folds: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Replaces the committed parts by one, each table through its fold (or as it is), then removes
        them. Readers that planned before it need the old files: run it between batches."""
        parts, last = self.committed(), self.last_batch()
        if len(parts) < 2:
            return
        for name in self.tables:
            self._write(name, folds.get(name, lambda df: df)(self.read(name)), f"c{last:012d}")
        self.commit(last, "c")
        for part in parts:
            for old in [f"commits/{part}", *[f"{name}/batch={part}" for name in self.tables]]:
                fs, at = self._at(old)
                fs.delete(at, True)
