"""A prepared corpus on disk: Parquet tables beside the settings that made them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexmill.config import Preparation

TABLES = ("documents", "segments", "active", "dtm", "forms")


@dataclass
class Prepared:
    """The tables and settings of one preparation; every analysis starts from these."""

    prep: Preparation
    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def write_prepared(spark: SparkSession, folder: str, prep: Preparation, tables: dict[str, DataFrame]) -> Prepared:
    """Write tables and settings; analyses read them instead of segmenting again."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(prep.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/prepared")
    return read_prepared(spark, folder, tuple(tables))


def read_prepared(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> Prepared:
    """Read what :func:`write_prepared` wrote."""
    prep = Preparation.from_json(spark.read.text(f"{folder}/prepared").first()["value"])
    return Prepared(prep, {t: spark.read.parquet(f"{folder}/{t}") for t in tables})
