"""Document fingerprints: MinHash by universal hash permutations, bands joined in Spark.

Coordinate k of a fingerprint is the least of ``(a_k * x + b_k) mod 2**64 >> 32``
over the 32-bit shingles x, a 2-universal family; the coordinates of many
documents come from one numpy pass each.  Distinct shingle sets are joined by
band key in Spark, and exact Jaccard verifies every pair of sets that share a
band.  The result has one row a document; pairs are counted where they are
compared and not listed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import near
from lexmill.llm.common import need
from lexmill.llm.textkernel import U

PRODUCTION = near.Banding(shingle_words=3, bands=25, rows=4, threshold=0.6)


def universal_signer(coordinates: int, seed: int = 11) -> near.Signer:
    """A function from shingles of documents to their MinHash signatures."""
    random = np.random.default_rng(seed)
    a = random.integers(1, 1 << 63, size=coordinates, dtype=U) * U(2) + U(1)
    b = random.integers(0, 1 << 63, size=coordinates, dtype=U) * U(2)

    def permute(x: np.ndarray, k: int) -> np.ndarray:
        return ((x * a[k] + b[k]) >> U(32)).astype(np.uint32)

    return lambda shingles, starts: least_by_document(shingles.astype(U), starts, coordinates, permute)


def least_by_document(x: np.ndarray, starts: np.ndarray, coordinates: int, permute) -> np.ndarray:  # noqa: ANN001
    """The least of ``permute(x, k)`` of every document, a row a document and a column a coordinate.

    Documents are taken in runs that stay in the cache; a longer one is cut.
    """
    ends = np.append(starts[1:], len(x))
    out = np.full((len(starts), coordinates), 0xFFFFFFFF, dtype=np.uint32)
    lo, step = 0, 1 << 15
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, side="right")))
        for at in range(int(starts[lo]), int(ends[hi - 1]), step):
            part = x[at : min(at + step, int(ends[hi - 1]))]
            begins = starts[lo:hi] - at if hi - lo > 1 else np.zeros(1, dtype=np.int64)
            for k in range(coordinates):
                np.minimum(out[lo:hi, k], np.minimum.reduceat(permute(part, k), begins), out=out[lo:hi, k])
        lo = hi
    return out


def near_classes(spark: SparkSession, docs: DataFrame, banding: near.Banding = PRODUCTION) -> DataFrame:
    """(doc_id, class_id, set_id, n_links): one row a row of ``docs``.

    ``set_id`` is the least id of the documents with the same shingle set,
    ``n_links`` the number of other sets that share a band with it and whose
    Jaccard reaches the threshold, and ``class_id`` the least id of all
    documents joined by such links.  Nulls come last among ids.  Documents
    without a word (null, empty, only punctuation) are alone in their class;
    rows that repeat id and text are rows of one class.  ``docs`` needs doc_id
    and text, other columns are ignored.  An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    found = near.candidates(spark, docs, banding, lambda: universal_signer(banding.coordinates), "fingerprints")
    ws = found.ws
    own = found.members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # at most one a band
    placed = near.all_blocks(found.members.join(own, "node"), F.col("buckets"), F.lit(None).cast("binary"))
    links = ws.table(near.compare(placed, found.sets, banding.threshold), "links")
    labels = ws.table(near.components(ws, near.edges_of(links), "all"), "labels")
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")
    sets = found.feats.groupBy("node").agg(F.min(order).alias("s"))
    sets = ws.table(sets.join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    classes = sets.groupBy("label").agg(F.min("s").alias("c"))
    known = sets.join(classes, "label").select("node", F.col("c.doc_id").alias("class_id"), F.col("s.doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    some = found.feats.select("node", "doc_id").join(known, "node").select("doc_id", "class_id", "set_id", "n_links")
    return some.unionByName(without_words(docs, found.feats).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links")))


def without_words(docs: DataFrame, feats: DataFrame) -> DataFrame:
    """(doc_id) of the rows of ``docs`` that have no shingle."""
    digests = docs.select("doc_id", near.text_digest(F.col("text")).alias("digest"))
    return digests.join(feats.select("digest").distinct(), "digest", "left_anti").select("doc_id")
