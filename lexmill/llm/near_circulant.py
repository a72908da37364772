"""Near-duplicate removal by circulant MinHash.

Two permutations of the ring of ``2**32`` places make all signature coordinates:
the first scatters the shingles, and coordinate k is the least value of the
second, shifted circularly by k, over the places.  Both are bijective mixings of
32-bit numbers, so the ring needs no table, and disjoint sets of shingles never
agree in a coordinate however large they are.  Band keys make candidates; exact
Jaccard decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import near
from lexmill.llm.common import need
from lexmill.llm.fingerprints import least_by_document, without_words

PRODUCTION = near.Banding(shingle_words=3, bands=25, rows=4, threshold=0.6)

_W = np.uint32


def circulant_signer(coordinates: int, seed: int = 7) -> near.Signer:
    """A function from 32-bit shingles of documents to their signatures."""
    first, second = (_W(x | 1) for x in np.random.default_rng(seed).integers(1 << 30, 1 << 32, 2, dtype=np.uint64).tolist())

    def scatter(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> _W(16))) * first
        x ^= x >> _W(15)
        x *= second
        x ^= x >> _W(16)
        return x

    def shifted(places: np.ndarray, k: int) -> np.ndarray:
        y = places + _W(k)
        y ^= y >> _W(16)
        y *= _W(0x7FEB352D)
        y ^= y >> _W(15)
        y *= _W(0x846CA68B)
        return y

    return lambda shingles, starts: least_by_document(scatter(shingles), starts, coordinates, shifted)


def _search(spark: SparkSession, docs: DataFrame, banding: near.Banding) -> tuple[near.Found, DataFrame]:
    """(tables of the search, rows (doc_id, digest, node, label))."""
    need(docs, "doc_id", "text")
    found = near.candidates(spark, docs, banding, lambda: circulant_signer(banding.coordinates), "near-circulant")
    return found, near.grouped(found, near.group_labels(found, banding))


def near_dedup_report(spark: SparkSession, docs: DataFrame, banding: near.Banding = PRODUCTION) -> DataFrame:
    """One row a kept document: (doc_id, n_members, chunk, members).

    ``members`` lists the ids of its group, its own among them; a group of more
    than 10 000 is spread over rows (``chunk``).  Documents without a word
    (null, empty, only punctuation) are groups of their own, one a row of
    ``docs``.  Ties go to the least ``doc_id``, nulls last.  An empty table
    gives an empty result.
    """
    found, rows = _search(spark, docs, banding)
    kept = near.earliest(rows)
    listed = rows.join(kept, "label").select(F.col("label").alias("group"), "kept", "doc_id", "size")
    alone = without_words(docs, found.feats).select(
        F.col("doc_id"), F.lit(1).cast("long").alias("n_members"), F.lit(0).cast("long").alias("chunk"), F.array("doc_id").alias("members")
    )
    return near.member_lists(listed).unionByName(alone)


def near_dedup(spark: SparkSession, docs: DataFrame, banding: near.Banding = PRODUCTION) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns unchanged.

    The least ``doc_id`` of a group stays.  Documents without a word all stay.
    Rows that repeat both id and text count as one document.
    """
    found, rows = _search(spark, docs, banding)
    joined = rows.join(near.earliest(rows), "label")
    loses = ~(F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("digest") == F.col("kept_digest")))
    losers = found.ws.table(joined.where(loses).select("doc_id", "digest"), "losers")
    repeats = found.feats.groupBy("doc_id", "digest").count().where("count > 1")
    return near.drop_losers(docs, near.text_digest, losers, repeats)
