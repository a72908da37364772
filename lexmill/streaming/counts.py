"""Running form counts over a stream of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmill.functions import text as X
from lexmill.workers import checkpointing


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream of the files of one Parquet table, be it a single file or a folder of files."""
    known = spark.read.parquet(f"{folder}/{table}.parquet")
    inside = any(f"{table}.parquet/" in path for path in known.inputFiles())
    stream = spark.readStream.schema(known.schema)
    if inside:
        return stream.parquet(f"{folder}/{table}.parquet")
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def form_counts(stream: DataFrame) -> DataFrame:
    """(form, n) of all documents so far."""
    return stream.select(F.explode(X.tokens(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, form, n) with a bound on how late documents may come."""
    timed = stream.withWatermark(time, late).select(time, F.explode(X.tokens(F.col("text"))).alias("form"))
    return timed.groupBy(F.window(time, width), "form").agg(F.count("*").alias("n"))


def to_memory(counts: DataFrame, name: str) -> StreamingQuery:
    """Start a query that keeps the complete result in memory, for tests and small vocabularies."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).start()


def to_table(counts: DataFrame) -> DataFrame:
    """The complete result of a query once it has read all there is, by way of files: nothing of it comes to the driver.

    State and result lie in the folder of checkpoints, which all executors share.
    """
    spark = counts.sparkSession
    checkpointing(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    latest = spark.createDataFrame([], counts.schema)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/{number}")
        done.append(number)

    done: list[int] = []
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(counts.schema).parquet(f"{folder}/result/{max(done)}") if done else latest
