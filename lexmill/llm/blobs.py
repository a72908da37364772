"""Chunks of documents and sorted slices of hashes: long rows that compress well.

What is counted over a corpus grows with it.  Documents are gathered into chunks
of about ``chunk_words`` words; a chunk's distinct hashes are sorted, and slices
of them travel to the shard of their range, are merged there in numpy, and the
answers travel back in the same order.  An exchange moves a row a chunk and
shard, at most one a hash; a value that occurs everywhere is in each chunk once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.textkernel import U

_CODEC = "zstd"
_CHUNK_BYTES = 6 << 20


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, the same byte of all items together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(blob: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def steps(x: np.ndarray) -> bytes:
    """Differences (modulo 2**64) of a mostly sorted array of hashes."""
    d = x.copy()
    d[1:] -= x[:-1]
    return planes(d)


def unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, U), dtype=U)


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of hashes, so that sorted hashes fall into slices."""
    return (((hashes >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def slices(sorted_hashes: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the shards that have some."""
    edges = np.searchsorted(shard_of(sorted_hashes, n), np.arange(n + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(s), int(edges[s]), int(edges[s + 1])


PARTS = "shard long, chunk long, a binary, b binary"


def parts(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of :data:`PARTS`."""
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "chunk", "a", "b"])


def parts_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([parts(rows)])


def order_key(doc_id: Column, kind: T.DataType) -> Column:
    """A 64-bit key in the order of the ids: integers as they are, others by the first bytes of their MD5; null last."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        key = doc_id.cast("long")
    else:
        key = F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 15), 16, 10).cast("long")
    return F.coalesce(key, F.lit((1 << 63) - 1))


def chunked(docs: DataFrame, key: Column, chunk_bytes: int = _CHUNK_BYTES) -> DataFrame:
    """(chunk, doc_ids, keys, sizes, texts) of ``docs`` (doc_id, text), the documents of a chunk in the order of ``key``.

    ``sizes`` has each text's bytes, -1 for null; ``texts`` is all of them, compressed.
    """
    ids = docs.schema["doc_id"].dataType

    def flush(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        texts = table.column("text").combine_chunks().cast(pa.large_binary())
        size = pc.fill_null(pc.binary_length(texts), -1).to_numpy().astype(np.int64)
        _, offsets, data = pc.fill_null(texts, b"").buffers()
        raw = data.to_pybytes()[: int(np.maximum(size, 0).sum())] if data is not None else b""
        together = table.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], type=pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(together)], type=pa.int32()), together),
                pa.array([planes(table.column("key").to_numpy().astype(np.int64))], type=pa.binary()),
                pa.array([planes(size)], type=pa.binary()),
                pa.array([pa.compress(raw, _CODEC, asbytes=True)], type=pa.binary()),
            ],
            names=["chunk", "doc_ids", "keys", "sizes", "texts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            length = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            at = 0
            while at < len(batch):
                before = int(length[at - 1]) if at else 0
                stop = min(len(batch), int(np.searchsorted(length, before + chunk_bytes - size)) + 1)
                held.append(batch.slice(at, stop - at))
                size += int(length[stop - 1]) - before
                at = stop
                if size >= chunk_bytes:
                    yield flush(first + serial, held)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield flush(first + serial, held)

    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(ids)),
            *[T.StructField(c, T.BinaryType()) for c in ("keys", "sizes", "texts")],
        ]
    )
    return docs.select("doc_id", key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@dataclass
class Chunk:
    """The texts of one chunk: offsets by text, bytes, order keys and which texts are null."""

    off: np.ndarray
    data: np.ndarray
    keys: np.ndarray
    null: np.ndarray


def read_chunk(keys: bytes, sizes: bytes, texts: bytes) -> Chunk:
    size = unplanes(sizes, np.int64)
    off = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    raw = pa.decompress(texts, int(off[-1]), _CODEC, asbytes=True) if off[-1] else b""
    return Chunk(off, np.frombuffer(raw, dtype=np.uint8), unplanes(keys, np.int64), size < 0)


def with_replies(chunks: DataFrame, columns: list[str], *replies: DataFrame) -> DataFrame:
    """Rows of chunks (kind 'chunk') and of their replies (kind: the reply's number), to be grouped by chunk."""
    kinds = {f.name: f.dataType for f in chunks.schema}
    blank = [F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b")]
    out = chunks.select(F.lit("chunk").alias("kind"), "chunk", *blank, *columns)
    for k, reply in enumerate(replies):
        out = out.unionByName(reply.select(F.lit(str(k)).alias("kind"), "chunk", "shard", "a", "b", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns]))
    return out


def split_rows(table: pa.Table, n: int) -> tuple[dict, list[list[dict]]]:
    """(the chunk's row, the replies of each kind in the order of their shards)."""
    rows = table.to_pylist()
    return next(r for r in rows if r["kind"] == "chunk"), [sorted((r for r in rows if r["kind"] == str(k)), key=lambda r: r["shard"]) for k in range(n)]
