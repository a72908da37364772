"""Let Python workers import this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


#: Large arrays go back to the system when they are freed, else a worker that
#: is used again keeps the most that any of its tasks needed.
_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path.

    Enough where executors see the driver's files; elsewhere ship the package
    with ``--py-files``, which this leaves alone.
    """
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, _ROOT) if x)
    for name, value in _MEMORY.items():
        environment.setdefault(name, value)


def spread(table: DataFrame) -> DataFrame:
    """``table``, over all cores if it has fewer parts than these.

    A small table in one file is read by one task, and all that follows in its
    row stays there.  Tables of more parts are left as they are read.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def checkpointing(spark: SparkSession) -> None:
    """Make ``checkpoint()`` work: in the folder the session names, or for a local session in one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexmill-"))
