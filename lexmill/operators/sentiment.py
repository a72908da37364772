"""Lexicon-based sentiment with negation, and emotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.config import Preparation
from lexmill.functions import text as X
from lexmill.operators.lexicon import lexed

NEGATION_REACH = 3


def sentence_tokens(docs: DataFrame, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sent, pos, token): tokens by sentence; documents without tokens are absent."""
    sents = docs.select(F.col(id_column).alias("doc_id"), *keep, F.posexplode(X.sentences(F.col("text"))).alias("sent", "s"))
    return sents.select("doc_id", *keep, "sent", F.posexplode(X.tokens(F.col("s"))).alias("pos", "token"))


def extend_lexicon(polarity: DataFrame, user: DataFrame) -> DataFrame:
    """Polarities with a user's (forma, polaridade): p... is positive, n... negative; theirs come first."""
    kind = F.lower(F.substring(F.trim("polaridade"), 1, 1))
    mine = user.select(F.lower(F.trim("forma")).alias("lemma"), F.when(kind == "p", 1).when(kind == "n", -1).alias("polarity")).where("polarity is not null")
    mine = mine.groupBy("lemma").agg(F.max("polarity").alias("polarity"))
    return mine.unionByName(polarity.join(mine, "lemma", "left_anti").select("lemma", "polarity"))


def score(docs: DataFrame, lexicon: DataFrame, polarity: DataFrame, negations: tuple[str, ...], prep: Preparation = Preparation(), id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(doc_id, score, n_positive, n_negative, label) of every document.

    A negation turns the polarity of lemmas on the next three tokens of its
    sentence and isn't itself scored; a further negation starts the count anew.
    ``polarity`` is (lemma, polarity: 1 or -1).  Documents without a token score 0.
    """
    tokens = sentence_tokens(docs, id_column)
    is_negation = F.col("token").isin(*negations) if negations else F.lit(False)
    before = Window.partitionBy("doc_id", "sent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    near = tokens.withColumn("neg", is_negation).withColumn("last", F.last(F.when(F.col("neg"), F.col("pos")), ignorenulls=True).over(before))
    rows = lexed(near.where(~F.col("neg")).withColumnRenamed("pos", "pos_at"), lexicon, prep).join(polarity, "lemma")
    turned = F.coalesce(F.col("pos_at") - F.col("last") <= NEGATION_REACH, F.lit(False))
    rows = rows.withColumn("value", F.when(turned, -F.col("polarity")).otherwise(F.col("polarity")))
    sums = rows.groupBy("doc_id").agg(F.count_if(F.col("value") > 0).alias("n_positive"), F.count_if(F.col("value") < 0).alias("n_negative"))
    every = docs.select(F.col(id_column).alias("doc_id"), *keep)
    scored = every.join(sums, "doc_id", "left").na.fill(0, ["n_positive", "n_negative"]).withColumn("score", F.col("n_positive") - F.col("n_negative"))
    return scored.select("doc_id", *keep, "score", "n_positive", "n_negative", label(F.col("score")).alias("label"))


def label(value: F.Column) -> F.Column:
    """positive, negative or neutral."""
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("neutral")


def label_counts(scored: DataFrame) -> DataFrame:
    """(label, n)."""
    return scored.groupBy("label").agg(F.count("*").alias("n"))


def mean_by(scored: DataFrame, variable: str) -> DataFrame:
    """(value, mean_score, n) of a variable with more than one value; else no row."""
    groups = scored.where(F.col(variable).isNotNull()).groupBy(F.col(variable).alias("value")).agg(F.round(F.avg("score"), 2).alias("mean_score"), F.count("*").alias("n"))
    return groups.withColumn("k", F.count("*").over(Window.partitionBy())).where("k > 1").drop("k")


def emotions(docs: DataFrame, emotion_lexicon: DataFrame, categories: list[str], id_column: str = "doc_id") -> DataFrame:
    """(doc_id, one count a category): tokens that the lexicon (form, emotion) lists."""
    tokens = docs.select(F.col(id_column).alias("doc_id"), F.explode(X.tokens(F.col("text"))).alias("form"))
    hits = tokens.join(emotion_lexicon, "form").groupBy("doc_id").pivot("emotion", categories).agg(F.count(F.lit(1)))
    return docs.select(F.col(id_column).alias("doc_id")).join(hits, "doc_id", "left").na.fill(0, categories)


def mean_emotions(per_doc: DataFrame, categories: list[str]) -> DataFrame:
    """(emotion, mean)."""
    return per_doc.agg(*[F.avg(c).alias(c) for c in categories]).unpivot([], categories, "emotion", "mean").withColumn("mean", F.round("mean", 4))


def emotions_by(per_doc: DataFrame, values: DataFrame, categories: list[str]) -> DataFrame:
    """(value, one mean a category) for ``values`` (doc_id, value) of more than one value."""
    rows = per_doc.join(values, "doc_id").groupBy("value").agg(*[F.round(F.avg(c), 2).alias(c) for c in categories])
    return rows.withColumn("k", F.count("*").over(Window.partitionBy())).where("k > 1").drop("k")
