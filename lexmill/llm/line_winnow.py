"""Removal of repeated runs of words by winnowing.

The hashed unit is the word and not the line: passages are repeated from the
middle of one line to the middle of another, or without any line end, and whole
lines then miss their first and last words or all of them.  A *gram* is a run of
``gram_words`` words.  In every window of grams that spans ``min_words`` words the
gram of least hash is selected, so two equal runs of ``min_words`` words have the
same gram selected: no such repeat is missed.

1. The selected grams of all documents are joined by hash; those that occur once
   are done with.
2. Around every other one, at each of its positions, the match is extended to the
   left and to the right, word by word, to the runs of ``min_words`` words whose
   least gram it is.  These are joined by hash in turn, each with *all* other
   occurrences, and the first in the order of ``doc_id`` and position stays.
3. Later runs are removed.  A word thus goes if, and only if, it lies in a run of
   ``min_words`` words that occurs earlier in the corpus, whatever document that is in.

Both joins are by sorted slices of hashes (see ``blobs``): a chunk sends a hash
once, however often it has it, so boilerplate of a third of all documents is one
item a chunk, and no two texts are ever brought together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm import blobs
from lexmill.llm.common import Workspace, need, shards
from lexmill.llm.textkernel import SOLID_BYTES, U, range_hashes, run_hashes, sliding, spans


_NONE = U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Winnowing:
    """Lengths in words (a removed run has at least ``min_words``), and selected grams of a shard."""

    gram_words: int = 15
    min_words: int = 30
    shard_grams: int = 4 << 20
    chunk_bytes: int = 6 << 20

    @property
    def window(self) -> int:
        """Grams in a run of ``min_words`` words."""
        return self.min_words - self.gram_words + 1


@dataclass
class Words:
    """The words of a chunk: first bytes, hashes and offsets by text; the starts of runs of ``min_words``
    words, the hash of the gram at each word (greatest where none is) and the least gram of each run."""

    first: np.ndarray
    hashes: np.ndarray
    by_text: np.ndarray
    start: np.ndarray
    gram: np.ndarray
    least: np.ndarray


def words_of(off: np.ndarray, data: np.ndarray, w: Winnowing) -> Words:
    first, end = spans(data, off, SOLID_BYTES)
    hashes = range_hashes(data, first, end)
    by_text = np.searchsorted(first, off)
    n = len(hashes)
    left = np.repeat(by_text[1:], np.diff(by_text)) - np.arange(n)  # words to the text's end
    gram = np.full(n, _NONE, dtype=U)
    at = np.flatnonzero(left >= w.gram_words)
    gram[at] = np.minimum(run_hashes(hashes, at, w.gram_words), _NONE - U(1))
    start = np.flatnonzero(left >= w.min_words)
    return Words(first, hashes, by_text, start, gram, sliding(gram, w.window, least=True)[start])


def selected(found: Words, w: Winnowing) -> np.ndarray:
    """The hash of every selected gram, once for each word at which it is selected."""
    least = np.zeros(len(found.gram) + w.window - 1, dtype=U)
    least[found.start + w.window - 1] = found.least
    # a gram is selected if no run that holds it has a lesser one, ties too
    return found.gram[found.gram == sliding(least, w.window, least=False)[: len(found.gram)]]


def _send_grams(w: Winnowing, n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = blobs.read_chunk(row["keys"], row["sizes"], row["texts"])
                found = words_of(chunk.off, chunk.data, w)
                least, count = np.unique(selected(found, w), return_counts=True)
                twice = count > 1
                yield blobs.parts([(s, row["chunk"], blobs.steps(least[a:b]), np.packbits(twice[a:b]).tobytes()) for s, a, b in blobs.slices(least, n)])

    return run


def _repeated_grams(table: pa.Table) -> pa.Table:
    """Which of the grams sent occur more than once, a bit each."""
    rows = table.to_pylist()
    hashes = [blobs.unsteps(r["a"]) for r in rows]
    edge = np.cumsum([0, *map(len, hashes)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["b"], dtype=np.uint8), count=len(h)) for r, h in zip(rows, hashes, strict=True)]).astype(bool)
    _, code, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    often = twice | (count > 1)[code]
    return blobs.parts_table([(r["shard"], r["chunk"], np.packbits(often[edge[i] : edge[i + 1]]).tobytes(), None) for i, r in enumerate(rows)])


def _answered(hashes: np.ndarray, replies: list[dict], n_shards: int) -> np.ndarray:
    """A reply's bit for each of a chunk's sorted distinct hashes."""
    out = np.zeros(len(hashes), dtype=bool)
    by_shard = {r["shard"]: r["a"] for r in replies}
    for s, a, b in blobs.slices(hashes, n_shards):
        out[a:b] = np.unpackbits(np.frombuffer(by_shard[s], dtype=np.uint8), count=b - a).astype(bool)
    return out


def _candidates(found: Words, replies: list[dict], n: int, w: Winnowing) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the runs whose least gram occurs more than once."""
    turns = np.flatnonzero(np.concatenate([[True], found.least[1:] != found.least[:-1]])) if len(found.least) else found.start
    grams, code = np.unique(found.least[turns], return_inverse=True)
    often = _answered(grams, replies, n)[code]
    start = found.start[np.repeat(often, np.diff(np.append(turns, len(found.least))))]
    return start, run_hashes(found.hashes, start, w.min_words)


def _send_runs(w: Winnowing, n: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        row, (grams,) = blobs.split_rows(table, 1)
        chunk = blobs.read_chunk(row["keys"], row["sizes"], row["texts"])
        found = words_of(chunk.off, chunk.data, w)
        start, run_hash = _candidates(found, grams, n, w)
        hashes, first = np.unique(run_hash, return_index=True)
        owner = np.searchsorted(found.by_text, start[first], side="right") - 1
        keys = chunk.keys[owner]
        return blobs.parts_table([(s, row["chunk"], blobs.steps(hashes[a:b]), blobs.planes(keys[a:b])) for s, a, b in blobs.slices(hashes, n)])

    return run


def _first_runs(table: pa.Table) -> pa.Table:
    """Which of the runs sent are the first of their hash, a bit each."""
    rows = table.to_pylist()
    hashes = [blobs.unsteps(r["a"]) for r in rows]
    size = [len(h) for h in hashes]
    edge = np.cumsum([0, *size])
    together = np.concatenate(hashes)
    order = np.lexsort((np.repeat([r["chunk"] for r in rows], size), np.concatenate([blobs.unplanes(r["b"], np.int64) for r in rows]), together))
    ordered = together[order]
    won = np.zeros(len(order), dtype=bool)
    won[order] = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else False
    return blobs.parts_table([(r["shard"], r["chunk"], np.packbits(won[edge[i] : edge[i + 1]]).tobytes(), None) for i, r in enumerate(rows)])


def _clean(w: Winnowing, n: int, doc_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        row, (grams, firsts) = blobs.split_rows(table, 2)
        chunk = blobs.read_chunk(row["keys"], row["sizes"], row["texts"])
        found = words_of(chunk.off, chunk.data, w)
        begin, run_hash = _candidates(found, grams, n, w)
        hashes, first = np.unique(run_hash, return_index=True)
        stays = np.zeros(len(begin), dtype=bool)
        stays[first[_answered(hashes, firsts, n)]] = True
        gone = begin[~stays]
        n_words = len(found.first)
        cover = np.cumsum(np.bincount(gone, minlength=n_words + 1) - np.bincount(gone + w.min_words, minlength=n_words + 1)) > 0
        cover = cover[:n_words]
        # ranges of removed words; none goes on into the next text
        opens = cover & ~np.concatenate([[False], cover[:-1]])
        begins = found.by_text[:-1][np.diff(found.by_text) > 0]
        opens[begins] = cover[begins]
        start = np.flatnonzero(opens)
        text_end = np.repeat(found.by_text[1:], np.diff(found.by_text))[start] if len(start) else start
        idle = np.flatnonzero(~cover)
        stop = np.append(idle, n_words)[np.searchsorted(idle, start)] if len(start) else start
        stop = np.minimum(stop, text_end)
        # bytes from the first removed word to the next that stays, or to the text's end
        owner = np.searchsorted(found.by_text, start, side="right") - 1
        upto = np.where(stop < text_end, np.append(found.first, len(chunk.data))[stop], chunk.off[owner + 1])
        mark = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        np.add.at(mark, found.first[start], 1)
        np.add.at(mark, upto, -1)
        keep = np.cumsum(mark)[: len(chunk.data)] == 0
        off = np.concatenate([[0], np.cumsum(keep)])[chunk.off]
        data = chunk.data[keep].tobytes()
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data))
        texts = pa.array([None if z else t for z, t in zip(chunk.null, texts.to_pylist(), strict=True)], type=pa.string()) if chunk.null.any() else texts.cast(pa.string())
        base = found.by_text[owner]
        both = np.column_stack([start - base, stop - base]).ravel().astype(np.int32)
        ends = np.searchsorted(owner, np.arange(len(off))) * 2
        removed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(both, type=pa.int32()))
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], type=doc_type),
                "text": texts,
                "n_words": pa.array(np.diff(found.by_text).astype(np.int32)),
                "removed": removed,
            }
        )

    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, w: Winnowing = Winnowing()) -> DataFrame:  # noqa: B008
    """(doc_id, text, n_words, removed) of every row of ``docs``.

    ``text`` lacks the repeated runs, each with the white space after it;
    ``n_words`` counts the words of the original, and ``removed`` lists start and
    stop of its removed ranges of words, one after another.  The first occurrence
    stays, in the order of ``doc_id`` (integers by value, other ids by their MD5,
    nulls last; rows of one id in the order they are stored); a run repeated
    inside one document loses its later copies too.  A text all of which is a
    repeat becomes empty (but for white space before its first word); null texts
    stay null, and texts of fewer than ``min_words`` words are never touched.
    Other columns are ignored.  An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    ws = Workspace(spark, "line-winnow")
    ids = docs.schema["doc_id"].dataType
    chunks = ws.table(blobs.chunked(docs.select("doc_id", "text"), blobs.order_key(F.col("doc_id"), ids), w.chunk_bytes), "chunks")
    # selected grams are a known share of the words, and words have two bytes at least
    n = max(shards(spark), -(-chunks.count() * w.chunk_bytes // (w.window * w.shard_grams)))
    columns = ["keys", "sizes", "texts"]
    sent = chunks.select("chunk", *columns).mapInArrow(_send_grams(w, n), blobs.PARTS)
    grams = ws.table(sent.groupBy("shard").applyInArrow(_repeated_grams, blobs.PARTS), "grams")
    sent = blobs.with_replies(chunks, columns, grams).groupBy("chunk").applyInArrow(_send_runs(w, n), blobs.PARTS)
    firsts = ws.table(sent.groupBy("shard").applyInArrow(_first_runs, blobs.PARTS), "firsts")
    out = T.StructType(
        [
            T.StructField("doc_id", ids),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("removed", T.ArrayType(T.IntegerType())),
        ]
    )
    rows = blobs.with_replies(chunks, ["doc_ids", *columns], grams, firsts)
    return rows.groupBy("chunk").applyInArrow(_clean(w, n, to_arrow_type(ids)), out)
