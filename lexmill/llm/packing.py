"""Order-preserving packing into training windows by dynamic programming.

Documents stay in order and are cut, only at document or
sentence ends, into windows of ``capacity`` tokens.  A window of fewer tokens is
padded, one of more is truncated; the cuts minimise

    pad * padding + truncate * truncated tokens + cut * (cuts inside a document)

exactly.  With prefix sums P the best predecessor of unit end j is either the
least ``f(i) + pad * P(i)`` over the i whose window fits, a sliding window kept
in a monotone queue, or the least ``f(i) - truncate * P(i)`` over all earlier i,
a running minimum: one pass, linear in the sentences.

The order is cut by rank into blocks of ``block_docs`` consecutive documents that
are packed independently, each ending its last window; that is what is
distributed, and the cost is at most one padded window a block.  The order is
that of ``doc_id``, or the order in which documents are stored, so that what a
mixture has permuted stays so.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lexmill.llm.common import Workspace, need, shards
from lexmill.llm.textkernel import SOLID_BYTES, blocks, buffers, plain_strings, spans

_STOPS = np.zeros(256, dtype=bool)
_STOPS[[33, 46, 63]] = True


@dataclass(frozen=True)
class Packing:
    """Window size in tokens (words between white space) and the penalties."""

    capacity: int = 2048
    pad: int = 1
    truncate: int = 8
    cut: int = 16
    block_docs: int = 1024


def sentence_lengths(texts: pa.Array) -> Iterator[np.ndarray]:
    """Tokens of every sentence of every text.

    A sentence ends at a word that ends in ``. ! ?``, at a line end and at the
    text's end.
    """
    strings = plain_strings(texts)
    for start, stop in blocks(strings):
        off, data = buffers(strings.slice(start, stop - start))
        first, end = spans(data, off, SOLID_BYTES)
        by_text = np.searchsorted(first, off)
        closes = _STOPS[data[end - 1]] if len(end) else np.zeros(0, dtype=bool)
        lines = np.cumsum(data == 10)
        if len(first) > 1:
            closes[:-1] |= lines[first[1:]] != lines[end[:-1] - 1]
        last = by_text[1:][np.diff(by_text) > 0] - 1
        closes[last] = True
        ends = np.flatnonzero(closes) + 1
        cut = np.searchsorted(ends, by_text, side="right")
        for i in range(len(by_text) - 1):
            yield np.diff(np.concatenate([[by_text[i]], ends[cut[i] : cut[i + 1]]])).astype(np.int32)


def best_cuts(lengths: np.ndarray, document_end: np.ndarray, p: Packing) -> tuple[list[int], int]:
    """(unit ends of the windows, total penalty); ties go to the longer last window."""
    n = len(lengths)
    total = [0, *np.cumsum(lengths, dtype=np.int64).tolist()]
    inside = (~document_end).astype(np.int64) * p.cut
    inside = inside.tolist()
    capacity, pad, truncate = p.capacity, p.pad, p.truncate
    f, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    best_over, best_at, low = None, -1, 0
    for j in range(1, n + 1):
        pj = total[j]
        limit = pj - capacity
        while total[low] < limit:
            over = f[low] - truncate * total[low]
            if best_over is None or over < best_over:
                best_over, best_at = over, low
            low += 1
        while queue and queue[0][1] < low:
            queue.popleft()
        if queue:
            cost, at = queue[0][0] - pad * limit, queue[0][1]
            if best_over is not None and best_over + truncate * limit < cost:
                cost, at = best_over + truncate * limit, best_at
        else:
            cost, at = best_over + truncate * limit, best_at
        cost += inside[j - 1]
        f[j], back[j] = cost, at
        key = cost + pad * pj
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1], f[n]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [x.tobytes() for x in sentence_lengths(batch.column("text"))]
        columns = [batch.column("doc_id"), batch.column("place"), pa.array(lengths, type=pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "lengths"])


def _schema(ids: T.DataType) -> T.StructType:
    span = T.StructType([T.StructField("doc_id", ids), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    numbers = [T.StructField(c, T.IntegerType()) for c in ("window", "n_tokens", "padding", "truncated")]
    return T.StructType([T.StructField("block", T.LongType()), *numbers, T.StructField("doc_ids", T.ArrayType(ids)), T.StructField("spans", T.ArrayType(span))])


def _packer(p: Packing, schema: pa.Schema):  # noqa: ANN202
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        per_doc = [np.frombuffer(x, dtype=np.int32) for x in table.column("lengths").to_pylist()]
        ids = table.column("doc_id").to_pylist()
        sizes = np.array([len(x) for x in per_doc])
        rows = []
        if sizes.sum():
            lengths = np.concatenate(per_doc)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.zeros(len(lengths), dtype=bool)
            ends[np.cumsum(sizes)[sizes > 0] - 1] = True
            cuts, _ = best_cuts(lengths, ends, p)
            total = np.concatenate([[0], np.cumsum(lengths)])
            base = total[np.concatenate([[0], np.cumsum(sizes)])]
            block, start = table.column("block")[0].as_py(), 0
            for k, stop in enumerate(cuts):
                parts = []
                for d in range(owner[start], owner[stop - 1] + 1):
                    a, b = max(total[start], base[d]), min(total[stop], base[d + 1])
                    if b > a:
                        parts.append({"doc_id": ids[d], "start": int(a - base[d]), "stop": int(b - base[d])})
                n = int(total[stop] - total[start])
                rows.append((block, k, n, max(0, p.capacity - n), max(0, n - p.capacity), [x["doc_id"] for x in parts], parts))
                start = stop
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pack


def stored_place() -> Column:
    """Where a row is stored, of a table read from files: the order of file names, then of rows."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def id_place() -> Column:
    """The order of ``doc_id``, nulls last; of one id, that of the MD5 of the texts."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.md5("text").alias("tie"))


def ranked(ws: Workspace, units: DataFrame) -> DataFrame:
    """``units`` (place) with ``rank``, from 0 on, in the order of place.

    Rows are partitioned by ranges of the order, and a partition's first rank is
    the number of rows before it: no window spans more than one partition.
    """
    order = ["place", "uid"]  # the number of a stored row tells equal places apart
    n = max(shards(ws.spark), 1)
    sorted_units = units.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    held = ws.table(sorted_units, "ordered")
    counts = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())  # a number a partition
    before = np.concatenate([[0], np.cumsum([c for _, c in counts])]).tolist()
    starts = ws.spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part int, before long")
    within = Window.partitionBy("part").orderBy(*order)
    return held.withColumn("k", F.row_number().over(within)).join(F.broadcast(starts), "part").withColumn("rank", F.col("k") - 1 + F.col("before"))


def pack_windows(spark: SparkSession, docs: DataFrame, packing: Packing = Packing(), place: Column | None = None) -> DataFrame:  # noqa: B008
    """One row a window: (block, window, n_tokens, padding, truncated, doc_ids, spans).

    ``spans`` lists the token ranges [start, stop) of its documents, in order;
    ``n_tokens`` counts all of them, the last ``truncated`` of which lie beyond
    the capacity.  Every token of every document is in exactly one window.
    Documents are taken in the order of ``place``: by default ``id_place`` (ids of
    any type that has an order, null ids last, rows of one id by the MD5 of
    their texts), or ``stored_place``.  Each of several equal rows is packed.
    Documents without a token (null, empty, white space) are in no window.  A
    sentence longer than the capacity is a truncated window.  An empty table
    gives no windows.
    """
    need(docs, "doc_id", "text")
    ws = Workspace(spark, "packing")
    keyed = docs.select("doc_id", (id_place() if place is None else place).alias("place"), "text")
    schema = T.StructType([*keyed.schema.fields[:2], T.StructField("lengths", T.BinaryType())])
    units = ws.table(keyed.mapInArrow(_units, schema).withColumn("uid", F.monotonically_increasing_id()), "units")
    blocks_of = ranked(ws, units).withColumn("block", F.floor(F.col("rank") / F.lit(packing.block_docs)).cast("long"))
    out = _schema(docs.schema["doc_id"].dataType)
    return blocks_of.select("block", "rank", "doc_id", "lengths").groupBy("block").applyInArrow(_packer(packing, to_arrow_schema(out)), out)
