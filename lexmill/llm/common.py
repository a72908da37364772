"""What the operators share: intermediate tables, row packing, checked broadcast."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.workers import importable

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` comes first, then a checkpoint folder set on the
    context.  Only a local session without either gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    chosen = context.getCheckpointDir()
    if chosen:
        return chosen
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return context.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, table in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # as below  # noqa: BLE001
            pass
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone at exit, and its folder is its owner's  # noqa: BLE001
            pass


class Workspace:
    """Intermediate tables of one operator run, written where executors share them.

    A table that has been written no longer depends on the tasks, or on the
    executors, that made it: the lineage is cut there.
    """

    _serial = itertools.count()

    def __init__(self, spark: SparkSession, name: str) -> None:
        importable(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{next(self._serial)}-{uuid.uuid4().hex[:12]}"
        _written.append((spark, self.root))

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _shuffle_cleanup(self.spark):
            writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """Write ``df`` in as many buckets of ``column`` as an exchange has parts: grouping by it moves no row."""
        table = f"spark_catalog.default.lexmill_{uuid.uuid4().hex}"  # buckets need a catalog; the entry goes at exit
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
        with _shuffle_cleanup(self.spark):
            writer.bucketBy(shards(self.spark), column).saveAsTable(table)
        _tables.append((self.spark, table))
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, f"{self.root}/{name}")


class _shuffle_cleanup:
    """While a table is written: its shuffle files go as soon as it is there."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *exc: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


def shards(spark: SparkSession) -> int:
    """Partitions that an exchange of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, *columns: Column, into: str = "row") -> DataFrame:
    """``columns`` beside all columns of ``df`` as one struct: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(into), *columns)


def unpacked(df: DataFrame, into: str = "row") -> DataFrame:
    """The columns that :func:`packed` put away."""
    return df.select(f"{into}.*")


def need(df: DataFrame, *columns: str) -> None:
    """Raise unless ``df`` has exactly one column of each name."""
    for name in columns:
        found = [c for c in df.columns if c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"one column {name!r} is needed, found {len(found)} among {df.columns}")
