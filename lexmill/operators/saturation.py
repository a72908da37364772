"""Saturation: what each further group of documents still adds."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.chd import Division, classify
from lexmill.operators.contingency import adjusted_rand

MISSING = ("", "nan", "none", "?")
THRESHOLDS = {"new_ratio": 0.05, "chd_ari": 0.80, "char_jaccard": 0.80}


def valid_groups(groups: DataFrame) -> DataFrame:
    """(group, k): named groups in the order of their labels, from 1."""
    named = groups.where(F.col("group").isNotNull() & ~F.lower(F.trim("group")).isin(*MISSING)).select("group").distinct()
    return named.withColumn("k", F.row_number().over(Window.orderBy("group")).cast("long"))


def vocabulary_curve(pairs: DataFrame, groups: DataFrame, order: DataFrame, min_segments: int = 3) -> DataFrame:
    """(k, vocab, new, new_ratio) after the first k groups.

    A form belongs to the vocabulary once ``min_segments`` segments of the groups
    so far hold it; one cumulative sum by form finds the step.
    """
    placed = pairs.join(groups.join(order, "group").select("uce_id", "k"), "uce_id")
    return curve_of_counts(placed.groupBy("form", "k").agg(F.count("*").alias("n")), order, min_segments)


def curve_of_counts(counts: DataFrame, order: DataFrame, min_segments: int = 3) -> DataFrame:
    """The same from the segments with a form in the k-th group (form, k, n)."""
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("form").orderBy("k")))
    entered = upto.where(F.col("upto") >= min_segments).groupBy("form").agg(F.min("k").alias("k"))
    new = entered.groupBy("k").agg(F.count("*").alias("new"))
    steps = order.select("k").join(new, "k", "left").na.fill(0, ["new"])
    curve = steps.withColumn("vocab", F.sum("new").over(Window.orderBy("k")))
    return curve.select("k", "vocab", "new", F.round(F.try_divide("new", "vocab"), 4).alias("new_ratio"))


@dataclass
class Step:
    """Classes and characteristic forms after a step; None where there is too little."""

    assign: DataFrame | None
    forms: set[tuple[str, ...]] | set[str]


def _step(pairs: DataFrame, chosen: DataFrame, min_segments: int, d: Division, top: int) -> Step:
    inside = pairs.join(chosen, "uce_id", "left_semi")
    kept = inside.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= min_segments).select("form")
    cells = inside.join(kept, "form", "left_semi")
    shape = cells.agg(F.count_distinct("form").alias("v"), F.count_distinct("uce_id").alias("n")).first()
    if shape["v"] < 2 or shape["n"] < 10:
        return Step(None, set())
    found = classify(cells, d)
    own = found.terms.where("sign = '+'").groupBy("form").agg(F.max("chi2").alias("chi2"))
    best = own.orderBy(F.desc("chi2"), F.desc("form")).limit(top).collect()
    return Step(found.assign, {r["form"] for r in best})


def saturation(pairs: DataFrame, groups: DataFrame, order: DataFrame, categories: dict[str, set[str]] | None = None, min_segments: int = 3, d: Division = Division(n_classes=4), top: int = 20) -> DataFrame:  # noqa: B008
    """The vocabulary curve with chd_ari, char_jaccard and the coverage of seed categories, step by step.

    The classes of a step are compared with those of the step before over their
    common segments (at least five); a step that is too small has nulls.
    """
    spark = pairs.sparkSession
    placed = groups.join(order, "group").select("uce_id", "k").cache()
    rows, before = [], None
    for (k,) in sorted(order.select("k").collect()):
        now = _step(pairs, placed.where(F.col("k") <= k).select("uce_id"), min_segments, d, top)
        ari = jaccard = None
        if before is not None and before.assign is not None and now.assign is not None:
            if now.assign.join(before.assign, "uce_id", "left_semi").count() >= 5:
                ari = adjusted_rand(now.assign, before.assign).first()["ari"]
            either = now.forms | before.forms
            jaccard = len(now.forms & before.forms) / len(either) if either else None
        rows.append((k, ari, jaccard))
        before = now
    metrics = spark.createDataFrame(rows, "k long, chd_ari double, char_jaccard double")
    curve = vocabulary_curve(pairs, groups, order, min_segments).join(metrics, "k")
    for name, seeds in (categories or {}).items():
        curve = curve.join(coverage(pairs, groups, order, seeds, min_segments).withColumnRenamed("covered", f"cat_{name}"), "k", "left")
    return curve


def coverage(pairs: DataFrame, groups: DataFrame, order: DataFrame, seeds: set[str], min_segments: int = 3) -> DataFrame:
    """(k, covered): share of a category's seed forms in the vocabulary after step k."""
    seeded = pairs.where(F.col("form").isin(*sorted(seeds)))
    return covered(vocabulary_curve(seeded, groups, order, min_segments), seeds)


def covered(curve: DataFrame, seeds: set[str]) -> DataFrame:
    """(k, covered) from the curve of the seed forms."""
    return curve.select("k", F.round(F.col("vocab") / max(1, len(seeds)), 2).alias("covered"))


def first_sustained(curve: DataFrame, ok: F.Column) -> DataFrame:
    """(k): the first step from which the condition holds to the end.

    A null doesn't break a run, but the run starts at a step where the condition
    is known.
    """
    rest = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    holds = F.min(F.coalesce(ok, F.lit(True))).over(rest)
    marked = curve.select("k", ok.alias("ok"), holds.alias("holds"))
    return marked.where("holds and ok").agg(F.min("k").alias("k"))


def breakdown(curve: DataFrame) -> DataFrame:
    """(criterion, k): where vocabulary, classes, characteristic forms and their combinations saturate; null if nowhere."""
    rules = {
        "vocabulary": F.col("new_ratio") < THRESHOLDS["new_ratio"],
        "classes": F.col("chd_ari") >= THRESHOLDS["chd_ari"],
        "characteristic": F.col("char_jaccard") >= THRESHOLDS["char_jaccard"],
    }
    parts = None
    for name, rule in rules.items():
        one = first_sustained(curve, rule).select(F.lit(name).alias("criterion"), "k")
        parts = one if parts is None else parts.unionByName(one)
    latest = lambda names: F.when(F.count_if(F.col("criterion").isin(*names) & F.col("k").isNotNull()) == len(names), F.max(F.when(F.col("criterion").isin(*names), F.col("k"))))
    structural = parts.agg(latest(["classes", "characteristic"]).alias("k")).select(F.lit("structural").alias("criterion"), "k")
    combined = parts.agg(latest(list(rules)).alias("k")).select(F.lit("combined").alias("criterion"), "k")
    return parts.unionByName(structural).unionByName(combined)


def category_saturation(curve: DataFrame, name: str) -> DataFrame:
    """(k): the step from which a category stays fully covered."""
    return first_sustained(curve, F.col(f"cat_{name}") >= 0.999)


def random_orders(pairs: DataFrame, groups: DataFrame, runs: int = 10, min_segments: int = 3, seed: int = 0) -> DataFrame:
    """(runs, n_reached, median_k, min_k, max_k): where the vocabulary saturates in random orders of the groups."""
    spark = pairs.sparkSession
    names = [r["group"] for r in valid_groups(groups).orderBy("group").collect()]
    shuffled, rows = random.Random(seed), []  # noqa: S311
    for _ in range(runs):
        order = names[:]
        shuffled.shuffle(order)
        table = spark.createDataFrame([(g, i) for i, g in enumerate(order, start=1)], "group string, k long")
        curve = vocabulary_curve(pairs, groups, table, min_segments)
        rows.append((first_sustained(curve, F.col("new_ratio") < THRESHOLDS["new_ratio"]).first()["k"],))
    reached = spark.createDataFrame(rows, "k long")
    return reached.agg(F.count("*").alias("runs"), F.count("k").alias("n_reached"), F.median("k").alias("median_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))
