"""Concordance, n-grams, word trees and key phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexmill.config import Preparation
from lexmill.errors import MatrixError
from lexmill.functions import text as X
from lexmill.operators import phrases
from lexmill.operators.chunks import lemmatised, rules
from lexmill.operators.lexicon import lemma_of, lexed, merge_all


def _hits(docs: DataFrame, query: str, lexicon: DataFrame, prep: Preparation, mode: str, id_column: str, keep: tuple[str, ...]) -> DataFrame:
    """(doc_id, tokens, position) of the tokens that match; the vocabulary is looked up, not every token."""
    spark = docs.sparkSession
    word = query.strip().lower()
    rows = docs.select(F.col(id_column).alias("doc_id"), *keep, X.tokens(F.col("text")).alias("tokens"))
    if mode == "exact":
        found = rows.select("*", F.posexplode("tokens").alias("position", "token")).where(F.col("token") == word)
        return found.drop("token")
    if mode != "lemma":
        raise ValueError(f"mode is lemma or exact, not {mode}")
    target = lemma_of(spark, word, lexicon, prep)
    placed = rows.select("*", F.posexplode("tokens").alias("position", "token"))
    # only forms of the lexicon and synonyms can have another lemma than themselves
    variants = lexicon.select(F.col("form").alias("token")).unionByName(spark.createDataFrame([(x,) for x in [*prep.synonyms, target]], "token string")).distinct()
    same = lexed(variants, lexicon, prep).where(F.col("lemma") == target).select("token")
    return placed.join(F.broadcast(same), "token", "left_semi").drop("token")


def concordance(docs: DataFrame, query: str, lexicon: DataFrame, prep: Preparation = Preparation(), window: int = 6, mode: str = "lemma", id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(doc_id, left, keyword, right, position) of every match; contexts are surface tokens and cross sentences."""
    hits = _hits(docs, query, lexicon, prep, mode, id_column, keep)
    at = F.col("position")
    start = F.greatest(at - window, F.lit(0))
    left = F.array_join(F.slice("tokens", start + 1, at - start), " ")
    right = F.array_join(F.slice("tokens", at + 2, F.lit(window)), " ")
    return hits.select("doc_id", *keep, left.alias("left"), F.element_at("tokens", at + 1).alias("keyword"), right.alias("right"), "position")


def ngrams(active: DataFrame, n: int = 2, top: int | None = 200) -> DataFrame:
    """(ngram, n) over the active lemmas of a segment in order; segments shorter than n have none."""
    rows = active.groupBy("uce_id").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("xs"))
    rows = rows.where(F.size("xs") >= n).select(F.transform("xs", lambda x: x["form"]).alias("fs"))
    grams = F.transform(F.sequence(F.lit(1), F.size("fs") - (n - 1)), lambda i: F.array_join(F.slice("fs", i, F.lit(n)), " "))
    counted = rows.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
    return counted if top is None else most_frequent(counted, top)


def most_frequent(counted: DataFrame, top: int = 200) -> DataFrame:
    """The most frequent of (ngram, n); ties in the order of the alphabet."""
    return counted.orderBy(F.desc("n"), "ngram").limit(top)


#: Tokens whose n-grams are counted before they are sent.
NGRAM_TOKENS = 2_000_000


def ngrams_of_segments(segs: DataFrame, lexicon: DataFrame, prep: Preparation, n: int = 2) -> DataFrame:
    """(ngram, n) of :func:`ngrams` from segments: runs are taken within their row, and counted by many segments before the shuffle."""
    known, most = rules(lexicon, prep), NGRAM_TOKENS
    words = segs.select(merge_all(F.col("tokens"), prep).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            forms, row, code = lemmatised(batch.column("words"), known)
            if len(row) < n:
                continue
            first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
            keys = code[first]
            for k in range(1, n):
                # pairs of codes become codes of their own, so no product overflows
                keys = np.unique(keys, return_inverse=True)[1] * len(forms) + code[first + k]
            keys, at, times = np.unique(keys, return_index=True, return_counts=True)
            texts = pc.binary_join_element_wise(*[forms.take(pa.array(code[first[at] + k])) for k in range(n)], " ")
            held.append((texts, times))
            size += len(texts)
            if size >= most:
                yield from _summed(held)
                held, size = [], 0
        if held:
            yield from _summed(held)

    return words.mapInArrow(run, "ngram string, n long").groupBy("ngram").agg(F.sum("n").alias("n"))


def _summed(held: list[tuple[pa.Array, np.ndarray]]) -> list[pa.RecordBatch]:
    """(ngram, n) of several counts."""
    table = pa.table({"ngram": pa.chunked_array([x for x, _ in held]), "n": np.concatenate([n for _, n in held]).astype(np.int64)})
    return table.group_by("ngram").aggregate([("n", "sum")]).rename_columns(["ngram", "n"]).to_batches(max_chunksize=1 << 16)


def word_tree(docs: DataFrame, query: str, lexicon: DataFrame, prep: Preparation = Preparation(), direction: str = "right", depth: int = 2, id_column: str = "doc_id") -> DataFrame:  # noqa: B008
    """(path, depth, n): the words that follow (or precede, nearest first) the matches of a lemma."""
    hits = _hits(docs, query, lexicon, prep, "lemma", id_column, ())
    at = F.col("position")
    if direction == "right":
        branch = F.slice("tokens", at + 2, F.lit(depth))
    else:
        start = F.greatest(at - depth, F.lit(0))
        branch = F.reverse(F.slice("tokens", start + 1, at - start))
    some = hits.select(branch.alias("b")).where("size(b) > 0")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("b")), lambda k: F.slice("b", F.lit(1), k))
    return some.select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count("*").alias("n")).select("path", F.size("path").alias("depth"), "n")


def render_tree(tree: DataFrame, root: str, most: int = 10_000) -> str:
    """The tree as indented text, frequent branches first; refused beyond ``most`` paths."""
    found = tree.limit(most + 1).collect()
    if len(found) > most:
        raise MatrixError(f"more than {most} paths; take a lesser depth")
    rows = sorted(((list(r["path"]), r["n"]) for r in found), key=lambda x: (len(x[0]), -x[1], x[0]))
    children: dict[tuple, list[tuple[int, str]]] = {}
    for path, n in rows:
        children.setdefault(tuple(path[:-1]), []).append((n, path[-1]))
    lines = [root]

    def walk(prefix: tuple) -> None:
        for n, word in sorted(children.get(prefix, []), key=lambda x: (-x[0], x[1])):
            lines.append("  " * (len(prefix) + 1) + f"{word} ({n})")
            walk((*prefix, word))

    walk(())
    return "\n".join(lines)


def inactive_surface(segs_tokens: DataFrame, lexicon: DataFrame, prep: Preparation) -> DataFrame:
    """(token): distinct surface tokens that aren't active."""
    return lexed(segs_tokens.select("token").distinct(), lexicon, prep).where(~F.col("active")).select("token")


def key_phrases(docs: DataFrame, stop: DataFrame, longest: int = 3, top: int = 30, id_column: str = "doc_id", most_alike: float = 0.9) -> DataFrame:
    """(phrase, score): key phrases by unsupervised term features; low scores are best.

    Term features are casing, position, frequency, relatedness to context and
    spread over sentences; a phrase's score combines those of its words and its
    own frequency.  Phrases neither start nor end with a stopword.  From the best
    on, a phrase is left out if an edit distance of so small a share of its
    length parts it from a better one that their likeness exceeds ``most_alike``.
    """
    table = phrases.spoken(docs).persist()
    n_sentences = docs.select(F.size(X.sentences(F.col("text"))).alias("k")).agg(F.coalesce(F.sum(F.greatest("k", F.lit(0))), F.lit(0)).alias("n_sent"))
    scored = phrases.terms(table, n_sentences, stop).persist()
    kept = _first_unlike(lambda most: phrases.best_phrases(table, scored, longest, most).limit(most).collect(), top, most_alike)
    table.unpersist()
    scored.unpersist()
    return docs.sparkSession.createDataFrame(kept, "phrase string, score double")


def _distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace) from one to the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _unlike(ranked: DataFrame, top: int, most_alike: float) -> DataFrame:
    """The first ``top`` phrases that aren't too much like a better one."""
    kept = _first_unlike(lambda most: ranked.limit(most).collect(), top, most_alike)
    return ranked.sparkSession.createDataFrame(kept, "phrase string, score double")


def _first_unlike(best: Callable[[int], list[Row]], top: int, most_alike: float) -> list[tuple[str, float]]:
    """The same of the rows that ``best`` gives of so many; read in order, in growing portions, until there are so many."""
    asked = 4 * top
    while True:
        rows, kept = best(asked), []
        for r in rows:
            alike = lambda x: 1 - _distance(r["phrase"], x) / max(len(r["phrase"]), len(x), 1)  # noqa: B023, E731
            if len(kept) < top and all(alike(x) <= most_alike for x, _ in kept):
                kept.append((r["phrase"], r["score"]))
        if len(kept) == top or len(rows) < asked:
            return kept
        asked *= 4
