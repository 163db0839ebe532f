"""A fact table on plain Parquet: versions are appended by scope, compacted scope by scope, and swapped by one commit.

``log/batch=n/group_id=s`` holds appended versions, ``state/run=n/group_id=s`` compacted ones, and ``manifest/run=n`` names, for each scope, the
run that holds its state, and the last batch in it. Spark's commit marker of the newest manifest is the swap: what a stopped
compaction has written before is not named by any manifest, so readers don't see it and the next one writes it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.temporal import latest
from tidemark.sources.shared import remove

#: Of batches and compacted rows; rows are written twice, so size counts.
CODEC = "zstd"


class FactTable:
    """A table at ``path`` with columns ``schema``, among them ``scope`` (a string, not null) and ``key``; later versions have larger ``order`` columns.

    One writer at a time; readers need no lock. A read of some scopes opens their folders only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, scope: str = "group_id", key: str = "uuid", order: tuple[str, str] = ("version_ts", "op_seq")):
        self.spark, self.path, self.scope, self.key, self.order = spark, path.rstrip("/"), scope, key, order
        self.columns = schema.names
        self.schema = T.StructType([*(f for f in schema.fields if f.name != scope), schema[scope]])

    def _numbers(self, folder: str, done: bool = False) -> list[int]:
        """Numbers of the folders ``name=n`` of a folder; ``done``: of those with a commit marker."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = [s.getPath() for s in files.listStatus(at) if "=" in s.getPath().getName()]
        return sorted(int(p.getName().split("=")[1]) for p in found if not done or files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, folder: str, number: str) -> DataFrame:
        fields = [T.StructField(number, T.LongType()), *self.schema.fields]
        return self.spark.read.schema(T.StructType(fields)).option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")

    def append(self, versions: DataFrame) -> int:
        """Add versions as one batch, written by scope where they are; returns its number. A batch whose write was stopped has no marker and is not read."""
        number = max(self._numbers("log"), default=-1) + 1
        versions.select(*self.columns).write.partitionBy(self.scope).parquet(f"{self.path}/log/batch={number}", compression=CODEC)
        return number

    def _manifest(self) -> tuple[DataFrame | None, int]:
        """(scope, run) of the newest commit, and the last batch that it holds."""
        runs = self._numbers("manifest", True)
        if not runs:
            return None, -1
        rows = self.spark.read.schema(f"{self.scope} string, run long, upto long").parquet(f"{self.path}/manifest/run={runs[-1]}")
        return rows.select(self.scope, "run"), rows.agg(F.max("upto")).first()[0]

    def _pending(self, upto: int) -> DataFrame | None:
        new = [n for n in self._numbers("log", True) if n > upto]
        return self._read("log", "batch").filter(F.col("batch").isin(new)).drop("batch") if new else None

    def _state(self, named: DataFrame) -> DataFrame:
        """Compacted rows that the manifest names: the join is on partition columns, so other folders are not opened."""
        return self._read("state", "run").join(F.broadcast(named), ["run", self.scope], "left_semi").drop("run")

    def read(self, scopes: list[str] | None = None) -> DataFrame:
        """The current version of each key, of all scopes or of these."""
        wanted: Column = F.lit(True) if scopes is None else F.col(self.scope).isin(scopes)
        named, upto = self._manifest()
        pending = self._pending(upto)
        parts = [x.filter(wanted) for x in (None if named is None else self._state(named.filter(wanted)), pending) if x is not None]
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        if pending is None:
            return parts[0].select(*self.columns)
        return latest(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], self.key, *self.order).select(*self.columns)

    def compact(self) -> int | None:
        """Bring pending batches into the state: scopes with new versions are rewritten, others keep their files; None if nothing is pending."""
        named, upto = self._manifest()
        pending = self._pending(upto)
        if pending is None:
            return None
        batch = self._numbers("log", True)[-1]
        run = max([*self._numbers("state"), *self._numbers("manifest")], default=-1) + 1
        touched = pending.select(self.scope).distinct()
        rows = pending if named is None else pending.unionByName(self._state(named.join(touched, self.scope, "left_semi")))
        now = latest(rows, self.key, *self.order)
        now.write.partitionBy(self.scope).parquet(f"{self.path}/state/run={run}", compression=CODEC)
        fresh = touched.select(self.scope, F.lit(run).cast("long").alias("run"))
        whole = fresh if named is None else fresh.unionByName(named.join(touched, self.scope, "left_anti"))
        whole.withColumn("upto", F.lit(batch).cast("long")).coalesce(1).write.parquet(f"{self.path}/manifest/run={run}")
        return run

    def vacuum(self) -> None:
        """Delete batches, runs and manifests that the newest manifest doesn't need; readers that began before it must have ended."""
        named, upto = self._manifest()
        if named is None:
            return
        used = {r.run for r in named.select("run").distinct().collect()}
        newest = self._numbers("manifest", True)[-1]
        for folder, number, gone in [("log", "batch", lambda n: n <= upto), ("state", "run", lambda n: n not in used), ("manifest", "run", lambda n: n != newest)]:
            for n in filter(gone, self._numbers(folder)):
                remove(self.spark, f"{self.path}/{folder}/{number}={n}")
