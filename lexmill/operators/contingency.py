"""Statistics of form-by-class tables: characteristic terms, specificities, proportions.

Inputs are long tables: ``pairs`` (uce_id, form) and ``classes`` (uce_id, class).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.numeric import hypergeometric_tail
from lexmill.operators.chunks import Chunk, each_with, local_forms

CHI2_THRESHOLD = 3.84


def form_class_table(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(form, class, n): segments of the class that hold the form; empty cells are absent."""
    return pairs.join(classes, "uce_id").groupBy("form", "class").agg(F.count("*").alias("n"))


def signed_chi2(n: Column, n_class: Column, n_form: Column, total: Column) -> tuple[Column, Column, Column]:
    """(chi-square of the 2 x 2 table without correction, sign, least expected cell)."""
    expected = n_class * n_form / total
    rest = (total - n_class) * (total - n_form) / total
    across = n_class * (total - n_form) / total
    down = (total - n_class) * n_form / total
    product = (n_class * (total - n_class)).cast("double") * (n_form * (total - n_form)).cast("double")
    chi2 = F.when(product > 0, total * F.pow(n * total - n_class * n_form, 2.0) / product).otherwise(0.0)
    return chi2, F.when(n >= expected, F.lit("+")).otherwise(F.lit("-")), F.least(expected, rest, across, down)


def characteristic_terms(pairs: DataFrame, classes: DataFrame, threshold: float = CHI2_THRESHOLD) -> DataFrame:
    """(class, form, chi2, sign, n_in_class, n_total, min_expected) of terms beyond the threshold.

    ``classes`` is cut down to the segments of ``pairs``.  Terms that a class
    doesn't hold at all aren't listed for it.
    """
    joined = pairs.join(classes, "uce_id")
    units = joined.select("uce_id", "class").distinct().groupBy("class").agg(F.count("*").alias("n_class"))
    return characteristic_cells(joined.groupBy("form", "class").agg(F.count("*").alias("n")), units, threshold)


def characteristic_cells(cells: DataFrame, units: DataFrame, threshold: float = CHI2_THRESHOLD) -> DataFrame:
    """The same from the counts (form, class, n) and the segments of each class (class, n_class); a class without a name has no terms."""
    units = units.withColumn("total", F.sum("n_class").over(Window.partitionBy()))
    cells = cells.where(F.col("class").isNotNull()).withColumnRenamed("n", "n_in_class").withColumn("n_total", F.sum("n_in_class").over(Window.partitionBy("form")))
    chi2, sign, least = signed_chi2(*[F.col(c).cast("double") for c in ("n_in_class", "n_class", "n_total", "total")])
    rows = cells.join(units, "class").select("class", "form", chi2.alias("raw"), sign.alias("sign"), "n_in_class", "n_total", F.round(least, 2).alias("min_expected"))
    return rows.where(F.col("raw") >= threshold).select("class", "form", F.round("raw", 4).alias("chi2"), "sign", "n_in_class", "n_total", "min_expected")


def typical_segments(pairs: DataFrame, classes: DataFrame, terms: DataFrame, top: int = 5) -> DataFrame:
    """(class, rank, uce_id, score): segments with the highest sum of chi-square of their class's own terms."""
    own = terms.where("sign = '+'").select("class", "form", "chi2")
    scored = pairs.join(classes, "uce_id").join(own, ["class", "form"]).groupBy("class", "uce_id").agg(F.round(F.sum("chi2"), 4).alias("score"))
    by_class = Window.partitionBy("class").orderBy(F.desc("score"), F.desc("uce_id"))
    return scored.withColumn("rank", F.row_number().over(by_class)).where(F.col("rank") <= top).select("class", "rank", "uce_id", "score")


def typical_of_chunks(table: DataFrame, column: str, terms: DataFrame, top: int = 5) -> DataFrame:
    """The same from a term table in chunks, of classes by a column of its segments: a chunk gets the chi-squares of its own forms and gives its best segments."""
    own = terms.where("sign = '+'").select("class", "form", "chi2")
    known = local_forms(table).select("chunk", "code", "form").join(own, "form").select("chunk", "code", "class", "chi2")

    def best(chunk: Chunk, known: pa.Table) -> pa.Table:
        labels, parts = chunk.unit(column), []
        for name in known.column("class").unique().to_pylist():
            mine = known.filter(pc.equal(known.column("class"), name))
            weight = np.full(len(chunk.forms), np.nan)
            weight[mine.column("code").to_numpy()] = mine.column("chi2").to_numpy()
            inside = pc.fill_null(pc.equal(labels, name), False).to_numpy(zero_copy_only=False)
            w = weight[chunk.codes]
            cell = ~np.isnan(w) & inside[chunk.rows]
            score = np.bincount(chunk.rows[cell], weights=w[cell], minlength=len(inside))
            some = np.unique(chunk.rows[cell])
            if len(some) > top:
                # scores are rounded later: those that may tie then stay
                some = some[score[some] >= np.partition(score[some], -top)[-top] - 1e-3]
            parts.append(pa.table({"class": pa.array([name] * len(some), pa.string()), "uce_id": chunk.unit("uce_id").take(pa.array(some)), "score": score[some]}))
        empty = pa.table({"class": pa.array([], pa.string()), "uce_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *parts])

    scored = each_with(table, known, best, "class string, uce_id string, score double").withColumn("score", F.round("score", 4))
    by_class = Window.partitionBy("class").orderBy(F.desc("score"), F.desc("uce_id"))
    return scored.withColumn("rank", F.row_number().over(by_class)).where(F.col("rank") <= top).select("class", "rank", "uce_id", "score")


def partition_warnings(classes: DataFrame, terms: DataFrame, asked: int, min_class_size: int = 5) -> DataFrame:
    """(warning, value): fewer classes than asked, small classes, terms with an expected cell below 5."""
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    few = sizes.agg(F.count("*").alias("value")).where(F.col("value") < asked).select(F.lit("fewer classes than asked").alias("warning"), "value")
    small = sizes.where(F.col("n") < 2 * min_class_size).select(F.concat(F.lit("small class "), F.col("class").cast("string")).alias("warning"), F.col("n").alias("value"))
    fragile = terms.where("min_expected < 5").agg(F.count("*").alias("value")).select(F.lit("terms with an expected count below 5").alias("warning"), "value")
    return few.unionByName(small).unionByName(fragile)


def part_table(pairs: DataFrame, parts: DataFrame, missing: str | None = None) -> DataFrame:
    """(variable, form, part, k) of long metadata ``parts`` (uce_id, variable, part), zeros included.

    A null or empty part is dropped, or named ``missing``.  Variables of a single
    value are skipped.
    """
    blank = F.col("part").isNull() | (F.trim("part") == "")
    named = parts.withColumn("part", F.when(blank, F.lit(missing)).otherwise(F.col("part"))).where("part is not null")
    return part_grid(pairs.join(named, "uce_id").groupBy("variable", "form", "part").agg(F.count("*").alias("k"))).select("variable", "form", "part", "k")


def part_grid(cells: DataFrame) -> DataFrame:
    """(variable, form, part, k, row) with zeros from the cells (variable, form, part, k) that are not: one row a form until the end."""
    values = cells.groupBy("variable").agg(F.sort_array(F.collect_set("part")).alias("parts")).where("size(parts) > 1")
    forms = cells.groupBy("variable", "form").agg(F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("ks"), F.sum("k").alias("row"))
    rows = forms.join(F.broadcast(values), "variable").select("variable", "form", "row", "ks", F.explode("parts").alias("part"))
    return rows.select("variable", "form", "part", F.coalesce(F.try_element_at("ks", F.col("part")), F.lit(0).cast("long")).alias("k"), "row")


def specificities(table: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(variable, form, part, score, sign, observed, expected) by the hypergeometric model.

    ``table`` is that of :func:`part_table`.  The score is minus the decimal
    logarithm of the tail that the cell lies in.
    """
    return _tails(table.join(table.groupBy("variable", "form").agg(F.sum("k").alias("row")), ["variable", "form"]), table, threshold)


def specificities_of_cells(cells: DataFrame, threshold: float = 2.0) -> DataFrame:
    """The same from the cells (variable, form, part, k) that are not zero."""
    return _tails(part_grid(cells), cells, threshold)


def _tails(grid: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """Scores of the cells with the sums of their rows; those of the parts are few and are broadcast, tails are taken where the cell is."""
    columns = counts.groupBy("variable", "part").agg(F.sum("k").alias("column"))
    columns = columns.withColumn("total", F.sum("column").over(Window.partitionBy("variable")))
    cells = grid.join(F.broadcast(columns), ["variable", "part"])
    expected = F.col("row") * F.col("column") / F.col("total")
    tail = hypergeometric_tail(*[F.col(c) for c in ("k", "total", "row", "column")], upper=F.col("k") >= expected)
    rows = cells.withColumn("raw", -F.log10(F.greatest(F.least(tail, F.lit(1.0)), F.lit(1e-300)))).where(F.col("raw") >= threshold)
    sign = F.when(F.col("k") >= expected, F.lit("+")).otherwise(F.lit("-"))
    return rows.select("variable", "form", "part", F.round("raw", 3).alias("score"), sign.alias("sign"), F.col("k").alias("observed"), F.round(expected, 3).alias("expected"))


def agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(pearson, sign_agreement) of signed scores in two tables (keys, score)."""
    both = left.select(*keys, F.col("score").alias("x")).join(right.select(*keys, F.col("score").alias("y")), keys)
    return both.agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.avg((F.signum("x") == F.signum("y")).cast("double")), 6).alias("sign_agreement"))


def class_proportions(pairs: DataFrame, classes: DataFrame, top: int = 20) -> DataFrame:
    """(form, class, share): share of a class's segments that hold each of the most spread forms."""
    units = pairs.join(classes, "uce_id").select("uce_id", "class").distinct().groupBy("class").agg(F.count("*").alias("n_class"))
    spread = most_spread(pairs.groupBy("form").agg(F.count("*").alias("n")), top)
    return proportions_of_cells(form_class_table(pairs.join(F.broadcast(spread), "form", "left_semi"), classes), units, spread)


def most_spread(forms: DataFrame, top: int = 20) -> DataFrame:
    """(form) of the most segments, of (form, n)."""
    return forms.orderBy(F.desc("n"), "form").limit(top).select("form")


def proportions_of_cells(cells: DataFrame, units: DataFrame, spread: DataFrame) -> DataFrame:
    """The same from (form, class, n), (class, n_class) and the forms to show."""
    grid = spread.crossJoin(units)
    return grid.join(cells, ["form", "class"], "left").select("form", "class", F.round(F.coalesce("n", F.lit(0)) / F.col("n_class"), 4).alias("share"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari) of two partitions (uce_id, class) over the units both have."""
    pairs = a.select("uce_id", F.col("class").alias("x")).join(b.select("uce_id", F.col("class").alias("y")), "uce_id")
    cells = pairs.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    rows = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(two("n").alias("sx"))
    columns = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(two("n").alias("sy"))
    whole = cells.agg(two("n").alias("s"), F.sum("n").alias("n"))
    one = whole.crossJoin(rows).crossJoin(columns)
    chance = F.col("sx") * F.col("sy") / (F.col("n") * (F.col("n") - 1) / 2)
    return one.select(F.round(F.try_divide(F.col("s") - chance, (F.col("sx") + F.col("sy")) / 2 - chance), 6).alias("ari"))
