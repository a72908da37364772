"""The sparse segment-by-form table in long form, counts and corpus diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.errors import MatrixError


def form_stats(active: DataFrame) -> DataFrame:
    """(form, freq, n_uce): occurrences and segments of every active form."""
    return active.groupBy("form").agg(F.count("*").alias("freq"), F.count_distinct("uce_id").alias("n_uce"))


def retained_forms(active: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """Statistics of the forms that occur often enough."""
    return form_stats(active).where(F.col("freq") >= min_occurrences)


def dtm(active: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """(uce_id, form), each once; segments without a retained form are in no row.

    One shuffle counts occurrences by (segment, form); the forms' totals come from
    those counts, not from the tokens.
    """
    cells = active.groupBy("uce_id", "form").agg(F.count("*").alias("n"))
    kept = cells.groupBy("form").agg(F.sum("n").alias("freq")).where(F.col("freq") >= min_occurrences)
    return cells.join(kept.select("form"), "form", "left_semi").select("uce_id", "form")


def check_dtm(pairs: DataFrame, least_segments: int = 4) -> DataFrame:
    """``pairs``, or an error if there are too few segments or no form."""
    n = pairs.select("uce_id").distinct().limit(least_segments).count()
    if n < least_segments:
        raise MatrixError(f"{n} segments with retained forms; {least_segments} are needed")
    return pairs


def row_sizes(pairs: DataFrame) -> DataFrame:
    """(uce_id, n_forms)."""
    return pairs.groupBy("uce_id").agg(F.count("*").alias("n_forms"))


def count_matrix(active: DataFrame, vocabulary: DataFrame, level: str = "uci") -> DataFrame:
    """(doc_id, form, n) over a fixed vocabulary, by document (``uci``) or segment (``uce``)."""
    unit = {"uci": "uci_id", "uce": "uce_id"}[level]
    rows = active.join(vocabulary.select("form"), "form", "left_semi")
    return rows.groupBy(F.col(unit).alias("doc_id"), "form").agg(F.count("*").alias("n"))


def diagnostics(segs: DataFrame, active: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """One row of corpus figures."""
    sizes = segs.select("uci_id", F.size("tokens").cast("long").alias("n"))
    held = dtm(active, min_occurrences).agg(F.count_distinct("uce_id").alias("n_filled"))
    return figures(sizes, form_stats(active), held, min_occurrences)


def figures(sizes: DataFrame, stats: DataFrame, filled: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """The same from the segments (uci_id, n tokens), the forms' statistics and the number of segments with a retained form (n_filled)."""
    by_uci = sizes.groupBy("uci_id").agg(F.count("*").alias("k"))
    one = by_uci.agg(F.count("*").alias("n_uci"), F.count_if(F.col("k") <= 1).alias("n_single_uce"))
    tokens = sizes.agg(
        F.count("*").alias("n_uce"),
        F.min("n").alias("tokens_min"),
        F.median("n").alias("tokens_median"),
        F.round(F.avg("n"), 1).alias("tokens_mean"),
        F.max("n").alias("tokens_max"),
        F.sum("n").alias("tokens_total"),
    )
    forms = stats.agg(
        F.sum("freq").alias("active_total"),
        F.count("*").alias("vocabulary"),
        F.count_if(F.col("freq") == 1).alias("hapax"),
        F.count_if(F.col("freq") >= min_occurrences).alias("retained_forms"),
    )
    row = one.crossJoin(tokens).crossJoin(forms).crossJoin(filled)
    return (
        row.withColumn("active_ratio", F.round(F.try_divide("active_total", "tokens_total"), 3))
        .withColumn("hapax_pct", F.round(F.try_divide(100 * F.col("hapax"), "vocabulary"), 1))
        .withColumn("filled_pct", F.round(F.try_divide(100 * F.col("n_filled"), "n_uce"), 1))
    )


def top_forms(active: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent forms; ties in the order of the alphabet."""
    return most_frequent(form_stats(active), n)


def most_frequent(stats: DataFrame, n: int = 15) -> DataFrame:
    """The same from (form, freq, n_uce)."""
    return stats.orderBy(F.desc("freq"), "form").limit(n)


def advice(figures: DataFrame) -> DataFrame:
    """(advice): warnings that the figures call for."""
    f = F.col
    rules = [
        (f("n_uce") < 30, "few segments: classes will be unstable"),
        (f("tokens_median") < 8, "segments are very short: raise the segment size"),
        (f("filled_pct") < 80, "many segments lose all forms: lower the frequency threshold"),
        (f("hapax_pct") > 60, "most forms occur once: check lemmas and spelling"),
        (f("retained_forms") < 20, "few forms are retained: lower the frequency threshold"),
        (f("n_single_uce") > 0.5 * f("n_uci"), "most documents are one segment: lower the segment size"),
    ]
    return figures.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("advice"))
