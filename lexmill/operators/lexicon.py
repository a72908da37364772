"""Lexical mapping: expressions, lemmas, parts of speech and the choice of active forms.

Dictionaries are DataFrames: ``lexicon`` (form, lemma, pos), ``pos_key`` (pos,
key: 1 active, 2 supplementary).  They are dimensions of a bounded size (words of
a language); the planner broadcasts them by its own size rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Preparation
from lexmill.errors import CorpusError

ALIASES = {"conj": "con"}
SUPPLEMENTARY_PREFIXES = ("art", "aux", "con", "pre", "pro", "ono")
ACTIVE_PREFIXES = ("nom", "ver", "adj", "adv", "num")
UNKNOWN_POS = "nom"

_EDGE, _MARK = "\x02", "\x01"
_BETWEEN = _EDGE + _EDGE


def resolve_key(pos: Column, configured: Column) -> Column:
    """1 for active, 2 for supplementary: the configured key, else by how the name begins, else active."""
    name = pos
    starts = lambda prefixes: name.rlike("^(?:" + "|".join(prefixes) + ")")
    return (
        F.when(configured.isNotNull(), configured)
        .when(name.endswith("_sup"), F.lit(2))
        .when(starts(SUPPLEMENTARY_PREFIXES), F.lit(2))
        .when(starts(ACTIVE_PREFIXES), F.lit(1))
        .otherwise(F.lit(1))
        .cast("int")
    )


def keyed_lexicon(lexicon: DataFrame, pos_key: DataFrame | None = None) -> DataFrame:
    """(form, lemma, pos, key), one row a form."""
    if pos_key is None:
        return lexicon.select("form", "lemma", "pos", resolve_key(F.col("pos"), F.lit(None).cast("int")).alias("key"))
    keys = pos_key.select(F.lower("pos").alias("kpos"), F.col("key").cast("int").alias("configured"))
    other = keys.select(F.col("kpos").alias("apos"), F.col("configured").alias("by_alias"))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    joined = lexicon.join(keys, F.col("pos") == F.col("kpos"), "left").join(other, F.element_at(alias, F.col("pos")) == F.col("apos"), "left")
    return joined.select("form", "lemma", "pos", resolve_key(F.col("pos"), F.coalesce("configured", "by_alias")).alias("key"))


def close_synonyms(pairs: dict[str, str]) -> dict[str, str]:
    """Chains followed to their end; within a cycle, to the first word met again."""
    closed = {}
    for word in pairs:
        seen, at = {word}, pairs[word]
        while at in pairs and at not in seen:
            seen.add(at)
            at = pairs[at]
        closed[word] = at
    return closed


#: Synonyms are a list that people write; a table beyond this isn't one.
MAX_SYNONYMS = 1_000_000


def close_synonyms_table(pairs: DataFrame) -> DataFrame:
    """(variant, canonical) with chains closed, of any length and with cycles; of several targets of a variant the least."""
    rows = pairs.groupBy("variant").agg(F.min("canonical").alias("canonical")).limit(MAX_SYNONYMS + 1).collect()
    if len(rows) > MAX_SYNONYMS:
        raise CorpusError(f"more than {MAX_SYNONYMS} synonyms")
    closed = close_synonyms({r["variant"]: r["canonical"] for r in rows})
    return pairs.sparkSession.createDataFrame(sorted(closed.items()), "variant string, canonical string")


def merge_expressions(words: Column, expressions: dict[str, str]) -> Column:
    """The array of words with phrases replaced: from the left, longest phrase first, none overlapping.

    One regular expression finds all phrases of the joined words, so the cost
    grows with the text alone; words hold no control characters.
    """
    phrases = {k: v for k, v in expressions.items() if len(k.split()) >= 2}
    if not phrases:
        return words
    table = F.create_map(*[F.lit(x) for k, v in phrases.items() for x in (_BETWEEN.join(k.split()), v)])
    # of two phrases that begin at one word the longer stands first and is tried first
    longest_first = sorted((k.split() for k in phrases), key=lambda ws: (-len(ws), ws))
    pattern = f"{_EDGE}(" + "|".join(_BETWEEN.join(re.escape(w) for w in ws) for ws in longest_first) + f"){_EDGE}"
    joined = F.concat(F.lit(_EDGE), F.array_join(words, _BETWEEN), F.lit(_EDGE))
    # what stood between marks is a phrase: every second piece
    pieces = F.split(F.regexp_replace(joined, pattern, f"{_MARK}$1{_MARK}"), _MARK)
    replaced = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(_EDGE), F.element_at(table, p), F.lit(_EDGE))).otherwise(p))
    merged = F.filter(F.split(F.array_join(replaced, ""), _EDGE), lambda w: w != "")
    return F.when(words.isNotNull(), merged)


def lexed(tokens: DataFrame, lexicon: DataFrame, prep: Preparation, token: str = "token") -> DataFrame:
    """``tokens`` with lemma, pos, known and active.

    Rules of activity, the first that holds: an anonymised name is not; the
    replacement of a user's expression is; a token below the least length, a
    stopword (token or lemma), an adverb or an unknown word, where these are
    switched off, is not; else the key of its part of speech decides.
    """
    spark = tokens.sparkSession
    words = lexicon.select(F.col("form").alias("lx_form"), F.col("lemma").alias("lx_lemma"), F.col("pos").alias("lx_pos"), F.col("key").alias("lx_key"))
    rows = tokens.join(words, F.col(token) == F.col("lx_form"), "left")
    base = F.coalesce("lx_lemma", F.col(token))
    closed = close_synonyms(prep.synonyms)
    if closed:
        pairs = spark.createDataFrame(list(closed.items()), "sy_from string, sy_to string")
        by_token = pairs.withColumnsRenamed({"sy_from": "st_from", "sy_to": "st_to"})
        rows = rows.join(pairs, base == F.col("sy_from"), "left").join(by_token, F.col(token) == F.col("st_from"), "left")
        lemma = F.coalesce("sy_to", "st_to", base)
    else:
        lemma = base
    rows = rows.withColumn("lemma", lemma).withColumn("pos", F.coalesce("lx_pos", F.lit(UNKNOWN_POS))).withColumn("known", F.col("lx_form").isNotNull())
    word = F.col(token)
    anonymous = word.startswith(prep.anonymous_prefix) if prep.anonymous_prefix else F.lit(False)
    expression = word.isin(*set(prep.expressions.values())) if prep.expressions else F.lit(False)
    stop = word.isin(*prep.stopwords) | F.col("lemma").isin(*prep.stopwords) if prep.stopwords else F.lit(False)
    adverb = F.lower("pos").startswith("adv") & F.lit(not prep.adverbs_active)
    unknown = ~F.col("known") & F.lit(not prep.unknown_active)
    active = (
        F.when(anonymous, False)
        .when(expression, True)
        .when(F.length(word) < prep.min_token_length, False)
        .when(stop, False)
        .when(adverb, False)
        .when(unknown, False)
        .otherwise(F.coalesce("lx_key", F.lit(1)) == 1)
    )
    return rows.withColumn("active", active).drop("lx_form", "lx_lemma", "lx_pos", "lx_key", "sy_from", "sy_to", "st_from", "st_to")


def lemma_of(spark: SparkSession, word: str, lexicon: DataFrame, prep: Preparation) -> str:
    """The lemma of one word, by the same rules."""
    one = spark.createDataFrame([(word.strip().lower(),)], "token string")
    return lexed(one, lexicon, prep).first()["lemma"]


def merge_all(words: Column, prep: Preparation) -> Column:
    """The user's expressions first, then the lexicon's over what is left."""
    return merge_expressions(merge_expressions(words, prep.expressions), prep.lexicon_expressions)
