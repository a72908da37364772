"""Mixing sources to target weights by temperature.

Source i with token share s_i gets the weight ``s_i ** t / sum_j s_j ** t``.  The
exponent t is bisected in [0, 1] (0: all sources alike, 1: as they come) to the
flattest mixture that keeps a repetition limit, or to a target entropy.  The
weights times the token budget are quotas.  A quota is realised by block
permutations: the documents of a source fall into blocks by a hash; each epoch
has a permutation of its own over the blocks; whole epochs are taken while the
quota lasts, then whole blocks of the next epoch in its order, then documents of
one last block in the order of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.common import Workspace, need, packed, shards
from lexmill.llm.textkernel import SOLID_BYTES, blocks, buffers, plain_strings, spans

BISECTIONS = 60


@dataclass(frozen=True)
class Mixing:
    """Budget as a share of all tokens, and one of two targets for the exponent."""

    budget: float = 1.0
    max_repetition: float | None = 1.5
    target_entropy: float | None = None
    block_tokens: int = 250_000
    seed: str = "mix"


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights of sources of so many tokens."""
    whole = sum(tokens)
    raised = [(n / whole) ** exponent for n in tokens]
    return [x / sum(raised) for x in raised]


def entropy(shares: list[float]) -> float:
    """In nats."""
    return -sum(x * math.log(x) for x in shares if x > 0)


def bisect_exponent(tokens: list[int], mixing: Mixing) -> float:
    """The exponent of the target; tokens are all positive.

    Both the repetition and the entropy are monotone in the exponent.  A target
    out of reach gives the nearer end of [0, 1].
    """
    whole = sum(tokens)

    def sharp_enough(t: float) -> bool:
        shares = weights(tokens, t)
        if mixing.target_entropy is not None:
            return entropy(shares) <= mixing.target_entropy
        return max(mixing.budget * whole * w / n for w, n in zip(shares, tokens, strict=True)) <= mixing.max_repetition

    if sharp_enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        if sharp_enough(middle):
            high = middle
        else:
            low = middle
    return high


def token_counts(texts: pa.Array) -> np.ndarray:
    """Words between white space, of whole texts."""
    strings, out = plain_strings(texts), []
    for start, stop in blocks(strings):
        off, data = buffers(strings.slice(start, stop - start))
        first, _ = spans(data, off, SOLID_BYTES)
        out.append(np.diff(np.searchsorted(first, off)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = pa.array(token_counts(batch.column("text")), type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("h"), n], names=["source", "h", "n_tokens"])


def _hash(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _block_of(h: Column, n_blocks: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n_blocks


def _turn(mixing: Mixing) -> Column:
    """What sorts the blocks of an epoch into its permutation."""
    return F.md5(F.concat_ws("|", F.lit(mixing.seed), F.col("epoch").cast("string"), F.coalesce("source", F.lit("")), F.col("block").cast("string")))


def plan(spark: SparkSession, docs: DataFrame, mixing: Mixing) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(copies by block, ranks by block and epoch, summary by source).

    copies: source, n_blocks, block, whole, last: a document of the block is
    taken ``whole`` times, and once more if its hash is at most ``last``.
    ranks: source, block, epoch, block_rank.
    """
    ws = Workspace(spark, "mixing")
    keyed = docs.select(F.col("source").cast("string").alias("source"), _hash(mixing.seed, F.col("doc_id")).alias("h"), "text")
    sizes = ws.table(keyed.mapInArrow(_count, "source string, h string, n_tokens long"), "sizes")
    by_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).where("n > 0").collect()
    by_source = sorted(((r["source"], r["n"]) for r in by_source), key=lambda x: (x[0] is None, x[0] or ""))
    tokens = [n for _, n in by_source]
    exponent = bisect_exponent(tokens, mixing) if tokens else 1.0
    shares = weights(tokens, exponent) if tokens else []
    summary = []
    for (source, n), w in zip(by_source, shares, strict=True):
        quota = int(mixing.budget * sum(tokens) * w + 0.5)
        summary.append({"source": source, "n_tokens": n, "weight": w, "quota": quota, "epochs": quota // n, "rest": quota % n, "n_blocks": -(-n // mixing.block_tokens)})
    schema = "source string, n_tokens long, weight double, quota long, epochs long, rest long, n_blocks long"
    sources = spark.createDataFrame([tuple(s.values()) for s in summary], schema)
    placed = sizes.join(F.broadcast(sources.select(F.col("source").alias("s"), "epochs", "rest", "n_blocks")), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("block", _block_of(F.col("h"), F.col("n_blocks")))
    per_block = ws.table(placed.groupBy("source", "epochs", "rest", "n_blocks", "block").agg(F.sum("n_tokens").alias("n")), "blocks")
    order = _turn(mixing)
    turns = per_block.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))).withColumn("o", order)
    by_epoch = Window.partitionBy("source", "epoch").orderBy("o", "block")
    turns = turns.withColumn("block_rank", F.row_number().over(by_epoch).cast("long") - 1).withColumn("upto", F.sum("n").over(by_epoch))
    turns = ws.table(turns, "turns")
    last_turn = turns.where("epoch = epochs").withColumn("left", F.col("rest") - (F.col("upto") - F.col("n")))
    # the one block in which the rest of the quota ends: its documents in the order of their hash
    ending = last_turn.where("left > 0 and left < n").select(F.col("source").alias("es"), F.col("block").alias("eb"), "left")
    inner = placed.join(ending, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")))
    by_hash = inner.groupBy("source", "block", "h", "left").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy("source", "block").orderBy("h")
    reached = by_hash.withColumn("upto", F.sum("n").over(running)).where("upto <= left")
    reached = reached.groupBy(F.col("source").alias("rs"), F.col("block").alias("rb")).agg(F.max("h").alias("h"))
    copies = (
        last_turn.join(reached, F.col("source").eqNullSafe(F.col("rs")) & (F.col("block") == F.col("rb")), "left")
        .withColumn("last", F.when(F.col("left") >= F.col("n"), F.lit("g")).otherwise(F.coalesce("h", F.lit(""))))
        .select("source", "n_blocks", "block", F.col("epochs").alias("whole"), "last")
    )
    return ws.table(copies, "copies"), turns.select("source", "block", "epoch", "block_rank"), summary


def mixed_rows(spark: SparkSession, docs: DataFrame, mixing: Mixing) -> tuple[DataFrame, DataFrame]:
    """(packed row, source, h, block, epoch) of every document taken, and the ranks."""
    need(docs, "doc_id", "text", "source")
    copies, ranks, summary = plan(spark, docs, mixing)
    sources = spark.createDataFrame([(s["source"], s["n_blocks"]) for s in summary], "s string, n_blocks long")
    rows = packed(docs, F.col("source").cast("string").alias("source"), _hash(mixing.seed, F.col("doc_id")).alias("h"))
    rows = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", _block_of(F.col("h"), F.col("n_blocks")))
    taken = copies.select(F.col("source").alias("cs"), F.col("block").alias("cb"), "whole", "last")
    rows = rows.join(taken, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")))
    times = F.col("whole") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0)
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return rows.select("row", "source", "h", "block", "epoch"), ranks


def mix(spark: SparkSession, docs: DataFrame, mixing: Mixing = Mixing()) -> DataFrame:  # noqa: B008
    """(doc_id, source, epoch, block, block_rank): the documents taken, once an epoch.

    The training order is (epoch, block_rank) within a source.  A null source is
    a source of its own; one without a token takes no part.  Null ids share one
    hash.  Rows that repeat an id are taken or left together.  Documents without
    a token go with their block.  An empty table gives an empty result.
    """
    rows, ranks = mixed_rows(spark, docs, mixing)
    keys = ranks.select(F.col("source").alias("ks"), F.col("block").alias("kb"), F.col("epoch").alias("ke"), "block_rank")
    rows = rows.select(F.col("row.doc_id").alias("doc_id"), "source", "epoch", "block")
    same = F.col("source").eqNullSafe(F.col("ks")) & (F.col("block") == F.col("kb")) & (F.col("epoch") == F.col("ke"))
    return rows.join(keys, same).select("doc_id", "source", "epoch", "block", "block_rank")


def mix_rows(spark: SparkSession, docs: DataFrame, mixing: Mixing = Mixing()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that the mixture takes, columns unchanged, repeated once an epoch.

    They are returned, and so written, in training order: by epoch, then block
    after block in the permutation of the epoch's blocks of all sources, then by
    the hash of the id within a block.
    """
    rows, _ = mixed_rows(spark, docs, mixing)
    order = [F.col("epoch"), _turn(mixing), F.col("source"), F.col("block"), F.col("h")]
    return rows.repartitionByRange(shards(spark), *order).sortWithinPartitions(*order).select("row.*")
