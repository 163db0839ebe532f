"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Local sessions without one get a folder of their own; clusters must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Owners of the tables that ``saved`` writes, the innermost last; without one they stay.
_OWNERS: list[Scratch] = []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    return _OWNERS[-1].saved(df) if _OWNERS else _written(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Shared tables of one computation: each can be dropped once its successor is written, all go at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in self.held))

    def saved(self, df: DataFrame) -> DataFrame:
        self.held.append(_written(df))
        return self.held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; those of others stay."""
        for table in tables:
            for entry in [x for x in self.held if x[0] is table]:
                remove(self.spark, entry[1])
                self.held.remove(entry)

    def released(self, table: DataFrame) -> DataFrame:
        """Give up this table: it stays, or goes with an outer owner."""
        for entry in [x for x in self.held if x[0] is table]:
            self.held.remove(entry)
            if _OWNERS and _OWNERS[-1] is not self:
                _OWNERS[-1].held.append(entry)
        return table

    @contextmanager
    def owning(self):
        """Tables that ``saved`` writes meanwhile belong to this scratch and go with it."""
        _OWNERS.append(self)
        try:
            yield self
        finally:
            _OWNERS.pop()


def alone(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose result is a table, and whose other saved tables go once that is written."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        with Scratch(spark) as own, own.owning():
            return own.released(own.saved(query(spark, *args)))

    return run
