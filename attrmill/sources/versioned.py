"""Versioned tables with upserts (S8): bucketed Parquet, copy on write, one mark a version.

Rows lie in a fixed number of buckets by a hash of the table's bucket columns. A change rewrites
only the buckets that it touches, as new files; a version is a small mark that says for each
bucket which write holds it. The mark is written last and never over another one: readers see
whole versions only, a failed write leaves the table as it was, and of two writers of the same
version one fails. Files that no kept version names are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # ---- marks ---------------------------------------------------------------------------

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("versions") if n[:1] == "v" and n[1:].isdigit())

    def _mark(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/versions/v{version:012d}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, version: int, mark: dict) -> None:
        """Written under a name of its own, then renamed, which fails if the version exists."""
        fs, draft = self._at(f"versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()
        _, final = self._at(f"versions/v{version:012d}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another job")

    # ---- reading -------------------------------------------------------------------------

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The newest (or a given) version; only the given buckets, if any are named."""
        version = self.versions()[-1] if version is None else version
        mark = self._mark(version)
        schema = StructType.fromJson(mark["schema"])
        held = {b: w for b, w in mark["writes"].items() if buckets is None or int(b) in buckets}
        paths = [f"{self.path}/data/{w}/{BUCKET}={b}" for b, w in held.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- writing -------------------------------------------------------------------------

    def _write(self, rows: DataFrame, bucket_by: list[str], n: int) -> tuple[str, list[int]]:
        """Writes rows by bucket; the name of the write and the buckets that have rows."""
        name = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*bucket_by), F.lit(n)).cast("int")
        placed = rows.withColumn(BUCKET, bucket).hint("rebalance", F.col(BUCKET))  # a large bucket is several tasks' files
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return name, sorted(int(f.split("=")[1]) for f in self._names(f"data/{name}") if f.startswith(BUCKET))

    def create(self, rows: DataFrame, bucket_by: list[str], buckets: int = 64) -> None:
        """The first version. Rows with the same bucket columns share a bucket."""
        name, filled = self._write(rows, bucket_by, buckets)
        self._commit(1, {"schema": rows.schema.jsonValue(), "bucket_by": bucket_by, "buckets": buckets, "writes": {str(b): name for b in filled}})

    def _rewrite(self, touched: DataFrame, change, base: int | None) -> int:
        """A new version in which `change(old rows)` stands in for the buckets of `touched`.
        `base` is the version that the change was made for; another writer since then fails it."""
        last = self.versions()[-1] if base is None else base
        mark = self._mark(last)
        bucket = F.pmod(F.xxhash64(*mark["bucket_by"]), F.lit(mark["buckets"])).cast("int")
        hit = sorted(r[0] for r in touched.select(bucket.alias("b")).distinct().collect())  # at most the number of buckets
        schema = StructType.fromJson(mark["schema"])
        rows = change(self.read(last, hit)).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        name, filled = self._write(rows, mark["bucket_by"], mark["buckets"])
        writes = {b: w for b, w in mark["writes"].items() if int(b) not in hit} | {str(b): name for b in filled}
        self._commit(last + 1, mark | {"writes": writes})
        return last + 1

    def upsert(self, new: DataFrame, key: list[str], order: list[str], base: int | None = None) -> int:
        """Rows of `new` replace those with the same key; the others stay. Of rows of `new` with the
        same key, the one with the largest `order` columns is kept (then the largest whole row).
        Null keys are equal to each other. `key` must hold the table's bucket columns."""
        rank = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *new.columns])])
        last = new.groupBy(*[F.col(c).alias(f"_key_{c}") for c in key]).agg(F.max(rank).alias("_best"))
        one = last.select(*[F.col(f"_best._{len(order) + i}").alias(c) for i, c in enumerate(new.columns)])
        return self._rewrite(one, lambda old: one.unionByName(_without(old, one, key), allowMissingColumns=True), base)

    def replace_groups(self, new: DataFrame, groups: DataFrame, base: int | None = None) -> int:
        """All rows of the given groups go, the rows of `new` come (each in one of the groups).
        A group without new rows is deleted; `groups` holds the table's bucket columns."""
        key = groups.columns
        return self._rewrite(groups, lambda old: _without(old, groups, key).unionByName(new.join(groups.distinct(), key, "left_semi"), allowMissingColumns=True), base)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the newest `keep` versions and the writes that none of them names
        (also those of failed jobs; run it while no other job writes)."""
        kept = self.versions()[-keep:]
        used = {w for v in kept for w in self._mark(v)["writes"].values()}
        gone = [f"versions/{n}" for n in self._names("versions") if n not in {f"v{v:012d}" for v in kept}]
        gone += [f"data/{w}" for w in self._names("data") if w not in used]
        for name in gone:
            fs, at = self._at(name)
            fs.delete(at, True)
        return gone


def _without(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    names = {c: f"_new_{c}" for c in key}
    side = new.select(*[F.col(c).alias(names[c]) for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & old[c].eqNullSafe(F.col(names[c]))
    return old.join(side, same, "left_anti")
