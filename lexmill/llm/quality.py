"""Quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its features: every white-space
word, hashed as a whole; the character n-grams of the word between boundary marks
(characters are those of Unicode, never parts of one); and the word bigrams.  A bigram is hashed by the exclusive or of its words, so it has
no order, and all bigrams of a word with itself are one feature.  A softmax layer gives class probabilities.
Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled documents.

Scoring covers whole texts.  The layer is folded into the vectors first, so a
feature is one number a class; the words of a block are looked up once per
distinct word, and a document is a sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import Workspace, need, packed
from lexmill.llm.textkernel import SOLID_BYTES, U, blocks, buffers, mix, plain_strings, range_hashes, spans


@dataclass(frozen=True)
class Training:
    """``sample_rows`` bounds the labelled documents that are fitted; all else is the model's shape."""

    sample_rows: int = 4000
    word_buckets: int = 1 << 16
    gram_buckets: int = 1 << 17
    pair_buckets: int = 1 << 16
    gram_characters: tuple[int, ...] = (3, 4)
    dimensions: int = 16
    epochs: int = 8
    learning_rate: float = 0.7
    seed: int = 5
    threshold: float = 0.5


@dataclass
class Folded:
    """Score of every feature for class 1 against class 0, and the score without a feature."""

    weights: np.ndarray
    prior: float


@dataclass
class Model:
    """Input vectors (words, character n-grams, word bigrams), output layer and bias; class 1 is good."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> Folded:
        """What scoring needs: one number a feature, and the prior."""
        return Folded((self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every hash, position of the first of each code)."""
    codes, _ = pd.factorize(hashes)
    first = np.zeros(codes.max() + 1 if len(codes) else 0, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def _word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, t: Training) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets by word): the word's own feature, then those of its n-grams.

    The marks before and after the word are part of the n-grams at its ends: such
    an n-gram is one character shorter and salted by the side.
    """
    n_words = len(start)
    characters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each begins
    start, end = np.searchsorted(characters, start), np.searchsorted(characters, end)
    features = [(hashes % U(t.word_buckets)).astype(np.int64)]
    owners = [np.arange(n_words)]
    length = end - start
    for n in t.gram_characters:
        for salt, size, at_start, at_end in ((0, n, False, False), (1, n - 1, True, False), (2, n - 1, False, True)):
            if at_start or at_end:
                owner = np.flatnonzero(length >= size)
                a = start[owner] if at_start else end[owner] - size
            else:
                count = np.maximum(length - n + 1, 0)
                owner = np.repeat(np.arange(n_words), count)
                a = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            h = range_hashes(data, characters[a], characters[a + size])
            h = mix(h + U(salt * 0x9E37 + n))
            features.append((h % U(t.gram_buckets)).astype(np.int64) + t.word_buckets)
            owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(features)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_words))])


def _blocks_of_words(texts: pa.Array, t: Training) -> Iterator[tuple[np.ndarray, ...]]:
    """By block: (word offsets by text, code by word, features of distinct words, their offsets, bigram by word).

    The bigram of a word is the one that ends in it; -1 for a text's first word.
    """
    strings = plain_strings(texts)
    for lo, hi in blocks(strings):
        off, data = buffers(strings.slice(lo, hi - lo))
        start, end = spans(data, off, SOLID_BYTES)
        hashes = range_hashes(data, start, end)
        codes, first = _distinct(hashes)
        features, ends = _word_features(data, start[first], end[first], hashes[first], t)
        by_text = np.searchsorted(start, off)
        pairs = np.full(len(hashes), -1, dtype=np.int64)
        pairs[1:] = (mix(hashes[1:] ^ hashes[:-1]) % U(t.pair_buckets)).astype(np.int64) + t.word_buckets + t.gram_buckets
        pairs[by_text[:-1][np.diff(by_text) > 0]] = -1
        yield by_text, codes, features, ends, pairs


def document_features(texts: pa.Array, t: Training) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their shares) of every text."""
    for by_text, codes, features, ends, pairs in _blocks_of_words(texts, t):
        for i in range(len(by_text) - 1):
            n = np.bincount(codes[by_text[i] : by_text[i + 1]], minlength=len(ends) - 1)
            used = np.flatnonzero(n)
            count = np.diff(ends)[used]
            at = np.repeat(ends[used] - np.cumsum(count) + count, count) + np.arange(count.sum())
            pair = pairs[by_text[i] : by_text[i + 1]]
            pair = pair[pair >= 0]
            found, inverse = np.unique(np.concatenate([features[at], pair]), return_inverse=True)
            share = np.bincount(inverse, weights=np.concatenate([np.repeat(n[used], count), np.ones(len(pair))]), minlength=len(found))
            yield found, (share / max(1.0, share.sum())).astype(np.float32)


def score_texts(texts: pa.Array, folded: np.ndarray, prior: float, t: Training) -> np.ndarray:
    """Probability of class 1 of every text."""
    out = []
    for by_text, codes, features, ends, pairs in _blocks_of_words(texts, t):
        running = np.concatenate([[0.0], np.cumsum(folded[features], dtype=np.float64)])
        word_score, word_size = running[ends[1:]] - running[ends[:-1]], np.diff(ends)
        paired = pairs >= 0
        total = np.concatenate([[0.0], np.cumsum(word_score[codes] + np.where(paired, folded[pairs], 0.0))])
        size = np.concatenate([[0], np.cumsum(word_size[codes] + paired)])
        score = (total[by_text[1:]] - total[by_text[:-1]]) / np.maximum(1, size[by_text[1:]] - size[by_text[:-1]])
        out.append(1.0 / (1.0 + np.exp(-np.clip(score + prior, -60, 60))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(features: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, t: Training) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    random = np.random.default_rng(t.seed)
    vectors = random.uniform(-1, 1, (t.word_buckets + t.gram_buckets + t.pair_buckets, t.dimensions)).astype(np.float32) / t.dimensions
    layer = np.zeros((t.dimensions, 2), dtype=np.float32)
    share = (np.bincount(classes, minlength=2) + 0.5) / (len(classes) + 1.0)
    bias = np.log(share).astype(np.float32)
    steps, done = max(1, t.epochs * len(classes)), 0
    if len(classes) and classes.min() != classes.max():
        for _ in range(t.epochs):
            for i in random.permutation(len(classes)):
                rate = t.learning_rate * (1 - done / steps)
                done += 1
                at, w = features[i]
                if not len(at):
                    continue
                hidden = w @ vectors[at]
                logits = hidden @ layer + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[classes[i]] -= 1
                back = layer @ p
                layer -= rate * np.outer(hidden, p)
                vectors[at] -= (rate / float(w @ w)) * 0.05 * w[:, None] * back[None, :]
    return Model(vectors, layer, bias)


def _sample(docs: DataFrame, labels: DataFrame, t: Training) -> DataFrame:
    """(doc_id, quality, text) of at most ``sample_rows`` labelled documents, those with the least id hashes.

    Only labels of documents that are there count.  Of several labels of one id
    the least quality holds; of several texts the one of least MD5.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = docs.where("text is not null and doc_id is not null").select("doc_id", F.md5("text").alias("m"))
    both = held.groupBy("doc_id").agg(F.min("m").alias("m")).join(known, "doc_id")
    chosen = both.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(t.sample_rows)
    texts = docs.select("doc_id", "text").withColumn("m", F.md5("text"))
    return texts.join(F.broadcast(chosen), ["doc_id", "m"]).dropDuplicates(["doc_id"]).select("doc_id", "quality", "text")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Folded:  # noqa: B008
    """Fit on at most ``sample_rows`` labelled documents, in one task; only the folded model leaves it.

    Without labels, or with labels of one class, the model is the prior alone.
    """
    need(labels, "doc_id", "quality")
    ws = Workspace(spark, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            found = document_features(batch.column("text"), t)
            rows += zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), found, strict=True)
        rows.sort(key=lambda r: r[0])
        model = fit([r[2] for r in rows], np.array([int(r[1] > 0) for r in rows], dtype=np.int64), t)
        found = model.folded()
        yield pa.RecordBatch.from_pydict({"weights": pa.array([found.weights.tobytes()], type=pa.binary()), "prior": pa.array([found.prior])})

    sample = _sample(docs, labels, t).select("doc_id", "quality", "text")
    fitted = ws.table(sample.coalesce(1).mapInArrow(run, "weights binary, prior double"), "model").first()
    if fitted is None:
        return fit([], np.zeros(0, dtype=np.int64), t).folded()
    return Folded(np.frombuffer(fitted["weights"], dtype=np.float32), fitted["prior"])


def _scored(docs: DataFrame, model: Folded, t: Training) -> DataFrame:
    """(row, p_good) with all columns of ``docs`` in row."""
    folded = docs.sparkSession.sparkContext.broadcast(model.weights)  # one number a bucket, whatever the input
    prior = model.prior
    rows = packed(docs)
    place = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([rows.schema["row"], T.StructField("p_good", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score_texts(pc.struct_field(batch.column("row"), [place]).cast(pa.string()), folded.value, prior, t)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, type=pa.float64())], names=["row", "p_good"])

    return rows.mapInArrow(run, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:  # noqa: B008
    """(doc_id, p_good, quality) of every row of ``docs``; quality is 1 or 0.

    A text without a word (null, empty, white space) has no evidence and is
    scored by the prior.  Rows are scored one by one, so repeated rows and null
    ids are scored like any other.  An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    model = train(spark, docs, labels, t)
    rows = _scored(docs.select("doc_id", "text"), model, t)
    return rows.select("row.doc_id", "p_good", (F.col("p_good") >= t.threshold).cast("int").alias("quality"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged."""
    need(docs, "doc_id", "text")
    model = train(spark, docs, labels, t)
    return _scored(docs, model, t).where(F.col("p_good") >= t.threshold).select("row.*")
