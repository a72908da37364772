"""Segmentation into runs of sentences, and the token and active-form tables that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.config import Preparation
from lexmill.functions import text as X
from lexmill.operators.lexicon import lexed, merge_all


def _bounds(counts: Column, size: int) -> Column:
    """(first sentence, number of sentences) of every segment: one closes once it holds ``size`` tokens."""
    none = F.array().cast("array<struct<first:int,n:int>>")
    start = F.struct(F.lit(0).alias("held"), F.lit(1).alias("first"), F.lit(0).alias("n"), none.alias("out"))
    closed = lambda s, n: F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), n.alias("n"))))

    def step(state: Column, count: Column) -> Column:
        held, n = state["held"] + count, state["n"] + 1
        full = held >= size
        return F.struct(
            F.when(full, F.lit(0)).otherwise(held).alias("held"),
            F.when(full, state["first"] + n).otherwise(state["first"]).alias("first"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
            F.when(full, closed(state, n)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(counts, start, step, lambda s: F.when(s["n"] > 0, closed(s, s["n"])).otherwise(s["out"]))


def segments(docs: DataFrame, size: int = 40, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(uci_id, uce_index, uce_id, text, tokens) and the kept columns, one row a segment.

    Sentences are never split, so a segment may exceed ``size``; no shuffle: all
    happens within the row of the document.
    """
    rows = docs.select(F.col(id_column).alias("uci_id"), *keep, F.transform(X.sentences(F.col("text")), lambda s: F.struct(s.alias("s"), X.tokens(s).alias("t"))).alias("parts"))
    rows = rows.where(F.size("parts") > 0)
    bounds = _bounds(F.transform("parts", lambda p: F.size(p["t"])), size)
    rows = rows.select("uci_id", *keep, "parts", F.posexplode(bounds).alias("uce_index", "b"))
    rows = rows.select("uci_id", *keep, "uce_index", F.slice("parts", F.col("b.first"), F.col("b.n")).alias("parts"))
    return rows.select(
        "uci_id",
        *keep,
        "uce_index",
        F.format_string("%s__uce%04d", F.col("uci_id").cast("string"), F.col("uce_index")).alias("uce_id"),
        F.array_join(F.transform("parts", lambda p: p["s"]), " ").alias("text"),
        F.flatten(F.transform("parts", lambda p: p["t"])).alias("tokens"),
    )


def segment_tokens(segs: DataFrame, prep: Preparation = Preparation(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(uci_id, uce_id, pos, token), after the merging of expressions."""
    words = merge_all(F.col("tokens"), prep)
    return segs.select("uci_id", "uce_id", *keep, F.posexplode(words).alias("pos", "token"))


def active_forms(segs: DataFrame, lexicon: DataFrame, prep: Preparation = Preparation(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(uci_id, uce_id, pos, form): the active lemmas of every segment in order."""
    rows = lexed(segment_tokens(segs, prep, keep).withColumnRenamed("pos", "place"), lexicon, prep)
    return rows.where("active").select("uci_id", "uce_id", *keep, F.col("place").alias("pos"), F.col("lemma").alias("form"))
