"""Correspondence analysis of a form-by-class table with few classes.

The residual cross-product matrix of the classes (K x K) is summed in Spark;
only it comes to the driver.  Forms are projected by a join with the axes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.errors import MatrixError

MAX_CLASSES = 3000


@dataclass
class Correspondence:
    """``axes`` (axis, eigenvalue, pct), ``points`` (kind, label, axis, coord, cos2, contrib, mass), total inertia."""

    axes: DataFrame
    points: DataFrame
    total_inertia: float


def total_inertia(table: DataFrame) -> DataFrame:
    """(chi2, total_inertia, n) of (form, class, n); absent cells count as zeros."""
    cells = table.withColumn("r", F.sum("n").over(Window.partitionBy("form"))).withColumn("c", F.sum("n").over(Window.partitionBy("class")))
    sums = cells.agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("q"), F.sum("n").alias("n"))
    return sums.select(F.round(F.col("n") * (F.col("q") - 1), 4).alias("chi2"), F.round(F.col("q") - 1, 6).alias("total_inertia"), "n")


def analyse(table: DataFrame) -> Correspondence:
    """Masses, eigenvalues, principal coordinates, contributions and qualities.

    The sign of an axis is fixed by making the class of the largest weight
    positive.
    """
    spark = table.sparkSession
    table = table.where("n > 0").select("form", F.col("class").cast("string").alias("class"), F.col("n").cast("double").alias("n"))
    rows = table.groupBy("form").agg(F.sum("n").alias("r"))
    left = table.select("form", F.col("class").alias("a"), F.col("n").alias("x"))
    right = table.select("form", F.col("class").alias("b"), F.col("n").alias("y"))
    cross = left.join(right, "form").join(rows, "form").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y") / F.col("r")).alias("g"), F.sum(F.when(F.col("a") == F.col("b"), F.col("x"))).alias("c"))
    found = cross.limit(MAX_CLASSES**2 + 1).collect()
    labels = sorted({r["a"] for r in found})
    if not labels:
        raise MatrixError("the table is empty")
    if len(labels) > MAX_CLASSES:
        raise MatrixError(f"more than {MAX_CLASSES} classes")
    place = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    gram, column = np.zeros((k, k)), np.zeros(k)
    for r in found:
        gram[place[r["a"]], place[r["b"]]] = r["g"]
        if r["a"] == r["b"]:
            column[place[r["a"]]] = r["c"]
    n = column.sum()
    mass = column / n
    s = (gram / n - np.outer(mass, mass)) / np.sqrt(np.outer(mass, mass))
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    order = [i for i in np.argsort(-values) if values[i] > 1e-12]
    total = float(np.trace(s))
    axes, weights, class_rows = [], [], []
    for axis, i in enumerate(order, start=1):
        vector = vectors[:, i] * (1 if vectors[np.argmax(np.abs(vectors[:, i])), i] > 0 else -1)
        eigenvalue = float(values[i])
        axes.append((axis, eigenvalue, 100 * eigenvalue / total))
        weights += [(labels[j], axis, float(vector[j] / np.sqrt(mass[j])), eigenvalue) for j in range(k)]
        coordinate = vector / np.sqrt(mass) * np.sqrt(eigenvalue)
        class_rows += [("class", labels[j], axis, float(coordinate[j]), float(mass[j])) for j in range(k)]
    schema = "kind string, label string, axis int, coord double, mass double"
    axis_table = spark.createDataFrame(axes, "axis int, eigenvalue double, pct double")
    weight_table = spark.createDataFrame(weights, "class string, axis int, weight double, eigenvalue double")
    forms = (
        table.join(rows, "form")
        .join(F.broadcast(weight_table), "class")
        .groupBy("form", "axis")
        .agg(F.sum(F.col("n") / F.col("r") * F.col("weight")).alias("coord"), F.first("r").alias("r"))
        .select(F.lit("form").alias("kind"), F.col("form").alias("label"), "axis", "coord", (F.col("r") / n).alias("mass"))
    )
    points = forms.unionByName(spark.createDataFrame(class_rows, schema)).join(F.broadcast(axis_table), "axis")
    squared = F.pow("coord", F.lit(2.0))
    points = points.withColumn("contrib", F.col("mass") * squared / F.col("eigenvalue")).withColumn(
        "cos2", F.try_divide(squared, F.sum(squared).over(Window.partitionBy("kind", "label")))
    )
    return Correspondence(axis_table, points.select("kind", "label", "axis", "coord", "cos2", "contrib", "mass"), total)


def coordinates_table(result: Correspondence, axes: int = 3) -> DataFrame:
    """One row a point: coordinates, cos2 and contributions of the first axes, mass and two-axis quality."""
    shown = result.points.where(F.col("axis") <= axes)
    pick = lambda c, a: F.round(F.max(F.when(F.col("axis") == a, F.col(c))), 4)
    columns = [pick(c, a).alias(f"{name}{a}") for c, name in (("coord", "coord"), ("cos2", "cos2"), ("contrib", "contrib")) for a in range(1, axes + 1)]
    quality = F.round(F.sum(F.when(F.col("axis") <= 2, F.col("cos2"))), 4).alias("quality_2d")
    return shown.groupBy("kind", "label").agg(F.round(F.first("mass"), 5).alias("mass"), *columns, quality)
