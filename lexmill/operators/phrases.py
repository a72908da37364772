"""Key phrases from sentences in chunks of codes.

Three small tables are shuffled: the words' counts by chunk, the different pairs
of neighbours, and those phrases that can be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import chunks as C

#: Tokens after which a chunk is closed.
CHUNK_TOKENS = 2_000_000


def spoken(docs: DataFrame) -> DataFrame:
    """(chunk, words, upper, title, codes, lengths, sents): sentences with words; a sentence's number is its place in its document.

    ``upper`` and ``title`` count, by word, occurrences in capitals, and with a
    capital after the first place of a sentence.
    """
    most = CHUNK_TOKENS
    sents = docs.select(F.posexplode(X.sentences(F.col("text"))).alias("sent", "s"))
    raw = F.regexp_extract_all("s", F.lit(X.TOKEN), F.lit(0))
    upper = lambda w: F.when((F.length(w) > 1) & (F.upper(w) == w), 1).otherwise(0)
    title = lambda w, i: F.when(w.rlike(r"^\p{Lu}") & (i > 0), 2).otherwise(0)
    rows = sents.select("sent", raw.alias("ws")).where("size(ws) > 0")
    rows = rows.select("sent", F.transform("ws", F.lower).alias("ts"), F.transform("ws", lambda w, i: (upper(w) + title(w, i)).cast("byte")).alias("marks"))

    def closed(number: int, parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words = pa.chunked_array([p[0] for p in parts], pa.string()).unique()
        place = [pc.index_in(p[0], value_set=words).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]
        code = np.concatenate([m[p[1]] for m, p in zip(place, parts, strict=True)])
        marks, lengths, sents = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        count = lambda bit: np.bincount(code[(marks & bit) > 0], minlength=len(words)).astype(np.int32)
        columns = {"chunk": pa.array([number], pa.int64()), "words": one(words, None), "upper": one(count(1), pa.int32()), "title": one(count(2), pa.int32())}
        columns |= {name: pa.array([C._packed(x)], pa.binary()) for name, x in (("codes", code), ("lengths", lengths), ("sents", sents))}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ts = batch.column("ts")
            flat = ts.flatten().dictionary_encode()
            sizes = pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = batch.column("marks").flatten().to_numpy(zero_copy_only=False)
            parts.append((flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), marks, sizes, batch.column("sent").to_numpy(zero_copy_only=False)))
            held += len(flat)
            if held >= most:
                yield closed(number, parts)
                number, parts, held = number + 1, [], 0
        if parts:
            yield closed(number, parts)

    return rows.mapInArrow(run, "chunk long, words array<string>, upper array<int>, title array<int>, codes binary, lengths binary, sents binary")


def _read(table: pa.Table | pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, codes, sentence of each token, numbers of the sentences) of a row."""
    codes, lengths, sents = (C._unpacked(table.column(c)[i].as_py()) for c in ("codes", "lengths", "sents"))
    return table.column("words")[i].values, codes, np.repeat(np.arange(len(lengths)), lengths), sents


def _word_counts(table: DataFrame) -> DataFrame:
    """(t, tf, nu, nt, spread, cl, cr, at, times) by chunk and word: ``at`` the sentences' numbers, ``times`` how often there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, codes, sentence, sents = _read(batch, i)
                v = len(words)
                follows = sentence[1:] == sentence[:-1]
                count = lambda x: np.bincount(x, minlength=v).astype(np.int64)  # noqa: B023, E731
                top = int(sents.max()) + 1
                key, times = np.unique(codes * top + sents[sentence], return_counts=True)
                starts = np.searchsorted(key, np.arange(v + 1) * top).astype(np.int32)
                both = np.unique(codes * (len(sents) + 1) + sentence)
                out = {
                    "t": words, "tf": count(codes), "nu": batch.column("upper")[i].values.cast(pa.int64()), "nt": batch.column("title")[i].values.cast(pa.int64()),
                    "spread": count(both // (len(sents) + 1)), "cl": count(codes[1:][follows]), "cr": count(codes[:-1][follows]),
                    "at": pa.ListArray.from_arrays(pa.array(starts), pa.array((key % top).astype(np.int32))), "times": pa.ListArray.from_arrays(pa.array(starts), pa.array(times.astype(np.int32))),
                }
                yield from pa.table(out).to_batches(max_chunksize=1 << 15)

    schema = "t string, " + "".join(f"{c} long, " for c in ("tf", "nu", "nt", "spread", "cl", "cr")) + "at array<int>, times array<int>"
    return table.mapInArrow(run, schema)


def _neighbours(table: DataFrame) -> DataFrame:
    """(a, b): the different pairs of words that follow each other in a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, codes, sentence, _ = _read(batch, i)
                follows = sentence[1:] == sentence[:-1]
                key = np.unique(codes[:-1][follows] * len(words) + codes[1:][follows])
                yield from pa.table({"a": words.take(pa.array(key // len(words))), "b": words.take(pa.array(key % len(words)))}).to_batches(max_chunksize=1 << 16)

    return table.mapInArrow(run, "a string, b string").distinct()


def terms(table: DataFrame, n_sentences: DataFrame, stop: DataFrame) -> DataFrame:
    """(t, stop, tf, s): every word with its score; ``n_sentences`` is one row (n_sent)."""
    counts = ("tf", "nu", "nt", "spread", "cl", "cr")
    # one shuffle by word: its sums stand in the first of its rows, one a sentence's number
    parts = _word_counts(table).repartition("t").select("t", *counts, F.posexplode(F.arrays_zip("at", "times")).alias("k", "x"))
    sums = [F.sum(F.when(F.col("k") == 0, F.col(c)).otherwise(0)).alias(c) for c in counts]
    rows = parts.groupBy("t").agg(*sums, F.percentile(F.col("x.at") + 1, F.lit(0.5), F.col("x.times")).alias("mid"))
    # one shuffle of the different pairs, counted for both of their words
    ends = _neighbours(table).select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("r")), F.struct(F.col("b").alias("t"), F.lit(0).alias("r")))).alias("x"))
    beside = ends.groupBy(F.col("x.t").alias("t")).agg(F.sum(1 - F.col("x.r")).alias("dl"), F.sum("x.r").alias("dr"))
    rows = rows.join(beside, "t", "left").na.fill(0, ["dl", "dr"])
    stops = stop.select(F.col("token").alias("t"), F.lit(True).alias("stop"))
    rows = rows.join(stops, "t", "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    rows = rows.persist()
    own = F.when(~F.col("stop"), F.col("tf"))
    content = rows.agg(F.max("tf").alias("max_tf"), F.avg(own).alias("mean_tf"), F.coalesce(F.stddev_pop(own), F.lit(0.0)).alias("sd_tf"))
    overall = content.crossJoin(n_sentences)
    f = F.col
    casing = F.greatest("nu", "nt") / (1 + F.ln("tf"))
    position = F.ln(F.lit(3.0) + F.ln(f("mid") + 2))
    frequency = f("tf") / (f("mean_tf") + f("sd_tf"))
    related = 1 + (F.coalesce(F.try_divide("dl", "cl"), F.lit(0.0)) + F.coalesce(F.try_divide("dr", "cr"), F.lit(0.0))) * f("tf") / f("max_tf")
    spread = f("spread") / f("n_sent")
    scored = rows.crossJoin(F.broadcast(overall))
    return scored.select("t", "stop", "tf", (position * related / (casing + frequency / related + spread / related)).alias("s"))


def best_phrases(table: DataFrame, scored: DataFrame, longest: int, most: int) -> DataFrame:
    """(phrase, score) of at least the ``most`` best phrases, in order.

    A phrase occurs at most as often as its rarest word, which bounds its score
    from below.  The words alone are phrases too, whose scores are known: no
    phrase beyond the ``most``-th of these can be among the best.
    """
    own = scored.where(~F.col("stop")).select(F.round(F.col("s") / (F.col("tf") * (1 + F.col("s"))), 8).alias("score"))
    words = [r["score"] for r in own.orderBy("score").limit(most).collect()]
    bound = words[-1] + 1e-8 if len(words) == most else float("inf")
    listed = table.select("chunk", F.posexplode("words").alias("code", "t"))
    known = listed.join(scored, "t").select(F.col("chunk").alias("of"), "code", "stop", "tf", "s")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, codes, sentence, _ = _read(left, 0)
        at = right.column("code").to_numpy()
        stop, tf, s = np.ones(len(words), dtype=bool), np.zeros(len(words)), np.zeros(len(words))
        stop[at], tf[at], s[at] = right.column("stop").to_numpy(), right.column("tf").to_numpy(), right.column("s").to_numpy()
        parts = []
        for k in range(1, longest + 1):
            if len(codes) < k:
                break
            first = np.flatnonzero(sentence[: len(codes) - k + 1] == sentence[k - 1 :])
            first = first[~stop[codes[first]] & ~stop[codes[first + k - 1]]]
            product, total, rarest = np.ones(len(first)), np.zeros(len(first)), np.full(len(first), np.inf)
            for j in range(k):
                c = codes[first + j]
                product *= np.where(stop[c], 1.0, s[c])
                total += np.where(stop[c], 0.0, s[c])
                rarest = np.minimum(rarest, tf[c])
            can = product / (rarest * (1 + total)) <= bound
            first, product, total = first[can], product[can], total[can]
            key = codes[first]
            for j in range(1, k):
                key = np.unique(key, return_inverse=True)[1] * len(words) + codes[first + j]
            _, one, n = np.unique(key, return_index=True, return_counts=True)
            texts = pc.binary_join_element_wise(*[words.take(pa.array(codes[first[one] + j])) for j in range(k)], " ")
            parts.append(pa.table({"phrase": texts, "n": n.astype(np.int64), "product": product[one], "total": total[one]}))
        return pa.concat_tables(parts)

    found = table.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(run, "phrase string, n long, product double, total double")
    grouped = found.groupBy("phrase").agg(F.sum("n").alias("n"), F.min("product").alias("product"), F.min("total").alias("total"))
    return grouped.select("phrase", F.round(F.col("product") / (F.col("n") * (1 + F.col("total"))), 8).alias("score")).orderBy("score", "phrase")
