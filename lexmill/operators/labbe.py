"""Intertextual distance between groups of segments, and their clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.errors import MatrixError

MISSING = ("", "nan", "none", "null")
MAX_GROUPS = 2000


def group_table(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(form, group, n): segments of the group that hold the form; unnamed groups are left out."""
    return pairs.join(named(groups), "uce_id").groupBy("form", "group").agg(F.count("*").alias("n"))


def named(groups: DataFrame) -> DataFrame:
    """The rows whose group has a name."""
    return groups.where(F.col("group").isNotNull() & ~F.lower(F.trim("group")).isin(*MISSING))


def distances(table: DataFrame) -> DataFrame:
    """(group_a, group_b, distance) for all pairs of groups, a before b.

    The frequencies of the larger text are scaled to the length of the smaller;
    the distance is the sum of absolute differences over the two lengths.  With
    sums of minima, sum |x - y| = X + Y - 2 sum min(x, y), so only shared forms are
    joined.  Ties in length count a as the smaller.
    """
    sizes = table.groupBy("group").agg(F.sum("n").alias("size"))
    a = sizes.select(F.col("group").alias("group_a"), F.col("size").alias("na"))
    b = sizes.select(F.col("group").alias("group_b"), F.col("size").alias("nb"))
    grid = a.join(b, F.col("group_a") < F.col("group_b"))
    left = table.select("form", F.col("group").alias("group_a"), F.col("n").alias("x"))
    right = table.select("form", F.col("group").alias("group_b"), F.col("n").alias("y"))
    shared = left.join(right, "form").where("group_a < group_b").join(grid, ["group_a", "group_b"])
    small = F.least("na", "nb").cast("double")
    least = F.least(F.col("x") * small / F.col("na"), F.col("y") * small / F.col("nb"))
    common = shared.groupBy("group_a", "group_b").agg(F.sum(least).alias("common"))
    whole = grid.join(common, ["group_a", "group_b"], "left")
    return whole.select("group_a", "group_b", F.round(1 - F.coalesce("common", F.lit(0.0)) / small, 6).alias("distance"))


def matrix(pairs: DataFrame) -> DataFrame:
    """(group_a, group_b, distance) in both directions, with a zero diagonal."""
    entry = lambda a, b, d: F.struct(F.col(a).alias("group_a"), F.col(b).alias("group_b"), d.alias("distance"))
    own, zero = F.col("distance"), F.lit(0.0)
    cells = F.array(entry("group_a", "group_b", own), entry("group_b", "group_a", own), entry("group_a", "group_a", zero), entry("group_b", "group_b", zero))
    return pairs.select(F.explode(cells).alias("c")).select("c.*").distinct()


def extremes(pairs: DataFrame, top: int = 3) -> DataFrame:
    """(kind, rank, group_a, group_b, distance): the closest and the farthest pairs."""
    near = pairs.orderBy("distance", "group_a", "group_b").limit(top).withColumn("kind", F.lit("closest"))
    far = pairs.orderBy(F.desc("distance"), "group_a", "group_b").limit(top).withColumn("kind", F.lit("farthest"))
    return near.unionByName(far).select("kind", "group_a", "group_b", "distance")


def average_linkage(pairs: DataFrame) -> DataFrame:
    """(step, left, right, height, size): agglomeration of at least three groups by mean distance."""
    rows = pairs.limit(MAX_GROUPS**2).collect()
    names = sorted({r["group_a"] for r in rows} | {r["group_b"] for r in rows})
    if not 3 <= len(names) <= MAX_GROUPS:
        raise MatrixError(f"clustering needs 3 to {MAX_GROUPS} groups, not {len(names)}")
    d = {frozenset((r["group_a"], r["group_b"])): r["distance"] for r in rows}
    size = dict.fromkeys(names, 1)
    out = []
    while len(size) > 1:
        live = sorted(size)
        height, a, b = min((d[frozenset((x, y))], x, y) for i, x in enumerate(live) for y in live[i + 1 :])
        name = f"({a}+{b})"
        for c in live:
            if c not in (a, b):
                d[frozenset((name, c))] = (size[a] * d[frozenset((a, c))] + size[b] * d[frozenset((b, c))]) / (size[a] + size[b])
        size[name] = size.pop(a) + size.pop(b)
        out.append((len(out) + 1, a, b, float(height), size[name]))
    return pairs.sparkSession.createDataFrame(out, "step int, left string, right string, height double, size int")
