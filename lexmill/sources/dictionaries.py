"""Dictionaries: lexicon, keys, expressions, stopwords, synonyms, polarities."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.errors import LexiconError


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma, pos) of a tab-separated file; the last line of a form counts.

    An empty lemma is the form itself and an empty part of speech ``nom``.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where(F.size(parts) >= 3)
    clean = lambda i: F.trim(parts[i])
    rows = lines.select("n", clean(0).alias("form"), clean(1).alias("lemma"), clean(2).alias("pos")).where("form <> ''")
    last = rows.groupBy("form").agg(F.max_by(F.struct("lemma", "pos"), "n").alias("x"))
    out = last.select(
        "form",
        F.when(F.col("x.lemma") == "", F.col("form")).otherwise(F.col("x.lemma")).alias("lemma"),
        F.when(F.col("x.pos") == "", "nom").otherwise(F.col("x.pos")).alias("pos"),
    )
    if out.isEmpty():
        raise LexiconError(f"{path} has no entry")
    return out


def _whole(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in spark.read.text(path).collect()]


def read_keys(spark: SparkSession, path: str | None) -> DataFrame:
    """(pos, key) of the section KEYS; no file means no key."""
    rows: list[tuple[str, int]] = []
    if path is not None:
        parser = configparser.ConfigParser()
        parser.read_string("\n".join(_whole(spark, path)))
        if parser.has_section("KEYS"):
            rows = [(k, int(v)) for k, v in parser.items("KEYS")]
    return spark.createDataFrame(rows, "pos string, key int")


def read_expressions(spark: SparkSession, path: str) -> dict[str, str]:
    """Phrases and replacements of a lexicon: tab or white space parts them, the replacement comes last."""
    out = {}
    for line in _whole(spark, path):
        parts = line.split("\t") if "\t" in line else line.split()
        if len(parts) >= 2 and line.strip():
            phrase = " ".join(" ".join(parts[:-1]).lower().split())
            if phrase:
                out[phrase] = parts[-1].strip()
    return out


def read_user_expressions(spark: SparkSession, path: str) -> dict[str, str]:
    """A user's phrases, one a line; the words joined by ``_``, or what follows a tab, replace them."""
    out = {}
    for line in _whole(spark, path):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        phrase, _, replacement = line.partition("\t")
        words = phrase.lower().split()
        if len(words) >= 2:
            out[" ".join(words)] = replacement.strip() or "_".join(words)
    return out


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Words, one a line; ``#`` starts a comment."""
    words = (line.split("#", 1)[0].strip().lower() for line in _whole(spark, path))
    return tuple(sorted({w for w in words if w}))


def read_synonyms(spark: SparkSession, path: str) -> dict[str, str]:
    """Variants and canonical words; the first line decides between tab and comma, a header is skipped."""
    lines = [x for x in _whole(spark, path) if x.strip()]
    if not lines:
        return {}
    mark = "\t" if "\t" in lines[0] else ","
    out = {}
    for i, line in enumerate(lines):
        left, found, right = (x.strip().lower() for x in line.partition(mark))
        if not found and mark == ",":
            continue
        if i == 0 and left in ("variante", "variant", "from", "sinonimo", "synonym"):
            continue
        if left and right:
            out[left] = right
    return out


def read_polarities(spark: SparkSession, path: str) -> DataFrame:
    """A user's sentiment words (forma, polaridade) as strings."""
    return spark.read.csv(path, header=True, inferSchema=False).select("forma", "polaridade")
