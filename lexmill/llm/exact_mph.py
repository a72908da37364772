"""Exact duplicates by a minimal perfect hash over historical digests.

The distinct SHA-256 digests of the *historical* documents are spread over
shards; each shard is a minimal perfect hash of BBHash kind (levels of bit
vectors; a key is placed at the first level where no other key has its bit).
Slot s of a shard holds the full digest of the key placed there and the locator
(``doc_id``) of its winner.  Every later document's digest is looked up by the
hash and then compared byte by byte with the slot's digest: equal, the document
is a repeat of the slot's winner and done with; else it is no member.  Only
nonmembers are then grouped by digest among themselves.  The index is a written
table, one row a shard; a shard that many rows ask for, as they do for a text of
which there are very many copies, is copied to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm import near
from lexmill.llm.common import Workspace, need, shards
from lexmill.llm.textkernel import U, mix

DIGEST_BYTES = 32
#: Documents of a shard of the index, and rows that are looked up in one task.
SHARD_KEYS, TASK_ROWS = 200_000, 1_000_000
_MAX_LEVELS = 60


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's bytes; null for a null text."""
    return F.unhex(F.sha2(text, 256))


def _words(digests: list[bytes] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=U).reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level of ``size`` bits has each key."""
    h = mix(words[:, 0] + U((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    for k in range(1, 4):
        h = mix(h ^ words[:, k])
    return (h % U(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Minimal perfect hash of a set of digests: levels of bits and the rank before each."""

    levels: list[np.ndarray]

    @classmethod
    def build(cls, words: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        levels, rest = [], np.arange(len(words))
        while len(rest):
            if len(levels) == _MAX_LEVELS:
                raise ValueError("the digests are not distinct")
            size = max(8, int(gamma * len(rest)))
            at = _place(words[rest], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 where no level has it (surely no member)."""
        out = np.full(len(words), -1, dtype=np.int64)
        rest, before = np.arange(len(words)), 0
        for level, bits in enumerate(self.levels):
            if not len(rest):
                break
            at = _place(words[rest], level, len(bits))
            rank = np.cumsum(bits) - 1 + before
            hit = bits[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
            before += int(np.count_nonzero(bits))
        return out

    def to_bytes(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, sizes: list[int], blob: bytes) -> PerfectHash:
        levels, start = [], 0
        for size in sizes:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob[start : start + n], dtype=np.uint8), count=size).astype(bool))
            start += n
        return cls(levels)


def _index_schema(ids: T.DataType) -> T.StructType:
    fields = {"shard": T.LongType(), "sizes": T.ArrayType(T.LongType()), "bits": T.BinaryType(), "digests": T.BinaryType(), "locators": T.ArrayType(ids)}
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _build_shard(ids: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        words = _words(table.column("digest").to_pylist())
        hashed = PerfectHash.build(words)
        slots = hashed.slots(words)
        digests, at = np.empty_like(words), np.empty(len(slots), dtype=np.int64)
        digests[slots] = words
        at[slots] = np.arange(len(slots))
        locators = table.column("winner").combine_chunks().take(pa.array(at))
        sizes, bits = hashed.to_bytes()
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "sizes": pa.array([sizes], type=pa.list_(pa.int64())),
                "bits": pa.array([bits], type=pa.binary()),
                "digests": pa.array([digests.tobytes()], type=pa.binary()),
                "locators": pa.ListArray.from_arrays(pa.array([0, len(slots)], type=pa.int32()), locators.cast(ids)),
            }
        )

    return run


def _look_up(ids: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, index: pa.Table) -> pa.Table:
        """The rows, each with whether it is a member and with its winner if so."""
        member, winner = np.zeros(len(rows), dtype=bool), pa.nulls(len(rows), type=ids)
        if len(index) and len(rows):
            sizes, bits, digests = (index.column(c)[0].as_py() for c in ("sizes", "bits", "digests"))
            held = np.frombuffer(digests, dtype=U).reshape(-1, 4)
            words = _words(rows.column("digest").to_pylist())
            slots = PerfectHash.from_bytes(sizes, bits).slots(words)
            member = (slots >= 0) & (held[np.maximum(slots, 0)] == words).all(axis=1)
            winner = index.column("locators")[0].values.take(pa.array(slots, mask=~member))
        return pa.table({"doc_id": rows.column("doc_id"), "digest": rows.column("digest"), "member": pa.array(member), "winner": winner})

    return run


@dataclass
class Winners:
    """Written tables of one run: (doc_id, digest); (doc_id, digest, winner, historical) of every row with a text."""

    ws: Workspace
    digests: DataFrame
    resolved: DataFrame


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def build_index(ws: Workspace, old: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """(distinct historical digests and winners, the index table) of (doc_id, digest) rows; the least ``doc_id`` wins."""
    ids = old.schema["doc_id"].dataType
    distinct = ws.table(old.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("winner")), "distinct")
    keyed = distinct.withColumn("shard", _shard(n_shards))
    return distinct, ws.table(keyed.groupBy("shard").applyInArrow(_build_shard(to_arrow_type(ids)), _index_schema(ids)), "index")


def look_up(rows: DataFrame, index: DataFrame, n_shards: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, digest, member, winner) of (doc_id, digest) rows, each looked up by itself.

    Rows of a shard beyond ``task_rows`` are spread by their id over copies of
    the shard, so that a text of any number of copies fills no task.
    """
    ids = rows.schema["doc_id"].dataType
    keyed = rows.withColumn("shard", _shard(n_shards))
    copies = keyed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(task_rows)).alias("n"))
    keyed = keyed.join(F.broadcast(copies), "shard")  # a number for each of the shards that the session has
    keyed = keyed.withColumn("copy", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("n"))).drop("n")
    held = index.join(F.broadcast(copies), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    out = T.StructType([rows.schema["doc_id"], rows.schema["digest"], T.StructField("member", T.BooleanType()), T.StructField("winner", ids)])
    return keyed.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy")).applyInArrow(_look_up(to_arrow_type(ids)), out)


def _middle(digests: DataFrame) -> object:
    """An id that has about half of the ids before it."""
    kind = digests.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
        return None if low is None else low + (high - low) // 2
    return digests.where("doc_id is not null").agg(F.min_by("doc_id", F.md5(F.col("doc_id").cast("string")))).first()[0]


def find_winners(spark: SparkSession, docs: DataFrame, history: DataFrame | None = None) -> Winners:
    """Digest every document, index the historical ones and look up all others.

    Without ``history`` (doc_id, text) the older part of ``docs`` is the history:
    the lower half of the range of integer ids, or the ids up to a middling one
    where they aren't integers.  The winner of a group is its least ``doc_id``.
    """
    need(docs, "doc_id", "text")
    ws = Workspace(spark, "exact-mph")
    digests = ws.table(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    some = digests.where("digest is not null")
    if history is None:
        is_old = F.coalesce(F.col("doc_id") <= F.lit(_middle(digests)), F.lit(False))
        old, new = some.where(is_old), some.where(~is_old)
    else:
        need(history, "doc_id", "text")
        kind = docs.schema["doc_id"].dataType
        old, new = history.select(F.col("doc_id").cast(kind).alias("doc_id"), text_digest(F.col("text")).alias("digest")), some
    n = max(shards(spark), -(-digests.count() // SHARD_KEYS))
    distinct, index = build_index(ws, old, n)
    found = ws.table(look_up(new, index, n), "looked-up")
    members = found.where("member").select("doc_id", "digest", "winner", F.lit(True).alias("historical"))
    strangers = found.where("not member").select("doc_id", "digest")
    groups = strangers.groupBy("digest").agg(F.min("doc_id").alias("winner"))
    resolved = members.unionByName(strangers.join(groups, "digest").select("doc_id", "digest", "winner", F.lit(False).alias("historical")))
    if history is None:
        own = old.join(distinct, "digest").select("doc_id", "digest", "winner", F.lit(True).alias("historical"))
        resolved = resolved.unionByName(own)
    return Winners(ws, digests, ws.table(resolved, "resolved"))


def exact_dedup_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a kept document: (doc_id, n_members, chunk, members); ids of any type that has an order.

    ``members`` lists the ids of all documents with the same text, the kept one
    among them (chunked, see ``near.member_lists``).  A null text repeats no
    other and is a row of its own; an empty text is a text like any other.
    Repeated rows are listed as often as they occur.  An empty table gives an
    empty result.
    """
    found = find_winners(spark, docs)
    sizes = found.resolved.groupBy("digest").agg(F.count("*").alias("size"))
    rows = found.resolved.join(sizes, "digest").select(F.col("digest").alias("group"), F.col("winner").alias("kept"), "doc_id", "size")
    alone = found.digests.where("digest is null").select(
        "doc_id", F.lit(1).cast("long").alias("n_members"), F.lit(0).cast("long").alias("chunk"), F.array("doc_id").alias("members")
    )
    return near.member_lists(rows).unionByName(alone)


def exact_dedup(spark: SparkSession, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each distinct text, columns unchanged.

    The least ``doc_id`` stays (a historical document before any later one, and
    with an outside ``history`` none of its texts stays).  Null texts all stay;
    rows that repeat both id and text count as one document.
    """
    found = find_winners(spark, docs, history)
    loses = ~F.col("doc_id").eqNullSafe(F.col("winner"))
    if history is not None:
        loses = loses | F.col("historical")
    losers = found.ws.table(found.resolved.where(loses).select("doc_id", "digest"), "losers")
    repeats = found.digests.where("digest is not null").groupBy("doc_id", "digest").count().where("count > 1")
    return near.drop_losers(docs, text_digest, losers, repeats)
