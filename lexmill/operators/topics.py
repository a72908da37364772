"""Topic models over form counts."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.errors import MatrixError

#: The vocabulary and the topics' weights of its forms are on the driver, some 100 bytes a form.
MAX_FORMS = 1 << 23

METRICS = {"griffiths": True, "cao_juan": False, "arun": False, "deveaud": True}


def bags(counts: DataFrame) -> DataFrame:
    """(doc_id, forms): forms repeated as often as they occur; documents without a form are absent."""
    return counts.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("form", F.col("n").cast("int")))).alias("forms"))


def fit(counts: DataFrame, k: int = 3, iterations: int = 50, seed: int = 0, optimizer: str = "online") -> tuple[LDAModel, CountVectorizerModel, DataFrame]:
    """(model, vocabulary, vectors) of latent Dirichlet allocation on (doc_id, form, n).

    Forms are numbered by frequency, then by the alphabet.  Every iteration reads
    all vectors, so these are made once and kept; a part gives a dense table of
    all forms, so there are no more parts than cores.
    """
    totals = counts.groupBy("form").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "form").limit(MAX_FORMS + 1)
    forms = [r["form"] for r in totals.select("form").collect()]
    if len(forms) > MAX_FORMS:
        raise MatrixError(f"more than {MAX_FORMS} forms; topic models take no more, raise the least frequency")
    if not forms:
        raise MatrixError("no form to model")
    vocabulary = CountVectorizerModel.from_vocabulary(forms, inputCol="forms", outputCol="features")
    cores = counts.sparkSession.sparkContext.defaultParallelism
    vectors = vocabulary.transform(bags(counts)).select("doc_id", "features").coalesce(cores).persist()
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer=optimizer, featuresCol="features").fit(vectors)
    return model, vocabulary, vectors


def top_terms(model: LDAModel, vocabulary: CountVectorizerModel, n: int = 10) -> DataFrame:
    """(topic, rank, form, weight), topics from 1."""
    words = F.array(*[F.lit(x) for x in vocabulary.vocabulary]) if len(vocabulary.vocabulary) <= 500 else None
    described = model.describeTopics(n).select((F.col("topic") + 1).alias("topic"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    rows = described.select("topic", (F.col("rank") + 1).alias("rank"), F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    if words is not None:
        return rows.select("topic", "rank", F.element_at(words, F.col("i") + 1).alias("form"), "weight")
    needed = {r["i"] for r in rows.select("i").distinct().collect()}
    table = rows.sparkSession.createDataFrame([(i, vocabulary.vocabulary[i]) for i in sorted(needed)], "i int, form string")
    return rows.join(table, "i").select("topic", "rank", "form", "weight")


def dominant_topics(model: LDAModel, vectors: DataFrame) -> DataFrame:
    """(doc_id, topic): the most likely topic of each document, from 1."""
    shares = vector_to_array("topicDistribution")
    return model.transform(vectors).select("doc_id", F.array_position(shares, F.array_max(shares)).cast("int").alias("topic"))


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(topic, best, jaccard): for each topic of ``a`` the topic of ``b`` with the most similar top terms."""
    sets = lambda t, name: t.groupBy("topic").agg(F.collect_set("form").alias(f"s{name}")).withColumnRenamed("topic", name)
    pairs = sets(a, "topic").crossJoin(sets(b, "best"))
    jaccard = F.size(F.array_intersect("stopic", "sbest")) / F.size(F.array_union("stopic", "sbest"))
    order = Window.partitionBy("topic").orderBy(F.desc("jaccard"), "best")
    ranked = pairs.withColumn("jaccard", F.round(jaccard, 4)).withColumn("k", F.row_number().over(order))
    return ranked.where("k = 1").select("topic", "best", "jaccard")


def stability(counts: DataFrame, k: int = 3, seeds: int = 5, iterations: int = 50, n: int = 10) -> DataFrame:
    """(stability): mean best Jaccard of the top terms against models of other seeds."""
    model, vocabulary, _ = fit(counts, k, iterations, 0)
    base, parts = top_terms(model, vocabulary, n), None
    for seed in range(1, seeds + 1):
        other, words, _ = fit(counts, k, iterations, seed)
        found = align(base, top_terms(other, words, n))
        parts = found if parts is None else parts.unionByName(found)
    return parts.agg(F.round(F.avg("jaccard"), 4).alias("stability"))


def tune(counts: DataFrame, ks: range = range(2, 11), iterations: int = 20, seed: int = 0) -> DataFrame:
    """(k, griffiths, cao_juan, arun, deveaud) by the published formulas; griffiths is the log likelihood bound."""
    rows = []
    for k in ks:
        model, _, vectors = fit(counts, k, iterations, seed)
        phi = model.topicsMatrix().toArray().T
        phi = phi / phi.sum(axis=1, keepdims=True)
        unit = phi / np.linalg.norm(phi, axis=1, keepdims=True)
        cosine = unit @ unit.T
        i, j = np.triu_indices(k, 1)
        middle = (phi[i] + phi[j]) / 2
        safe = np.maximum(phi, 1e-300)
        divergence = 0.5 * (phi[i] * np.log(safe[i] / np.maximum(middle, 1e-300))).sum(1) + 0.5 * (phi[j] * np.log(safe[j] / np.maximum(middle, 1e-300))).sum(1)
        shares = vector_to_array("topicDistribution")
        length = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
        weighted = model.transform(vectors).select(*[F.sum(F.element_at(shares, t + 1) * length).alias(f"t{t}") for t in range(k)]).first()
        cm2 = np.sort(np.array(weighted, dtype=float))[::-1]
        cm2 /= cm2.sum()
        cm1 = np.linalg.svd(phi, compute_uv=False)
        cm1 /= cm1.sum()
        arun = float((cm1 * np.log(cm1 / cm2)).sum() + (cm2 * np.log(cm2 / cm1)).sum())
        rows.append((k, float(model.logLikelihood(vectors)), float(cosine[i, j].mean()), arun, float(divergence.mean())))
    return counts.sparkSession.createDataFrame(rows, "k int, griffiths double, cao_juan double, arun double, deveaud double")


def combine(tuning: DataFrame) -> DataFrame:
    """(k, support, suggested): metrics scaled to [0, 1], those to be minimised turned round, and their mean."""
    whole = Window.partitionBy()
    scaled = tuning
    for name, maximise in METRICS.items():
        low, high = F.min(name).over(whole), F.max(name).over(whole)
        unit = F.coalesce(F.try_divide(F.col(name) - low, high - low), F.lit(0.0))
        scaled = scaled.withColumn(f"u_{name}", unit if maximise else 1 - unit)
    support = sum((F.col(f"u_{n}") for n in METRICS), F.lit(0.0)) / len(METRICS)
    ranked = scaled.withColumn("support", F.round(support, 6))
    first = F.row_number().over(Window.orderBy(F.desc("support"), "k")) == 1
    return ranked.select("k", "support", first.alias("suggested"))


def best_by_metric(tuning: DataFrame) -> DataFrame:
    """(metric, k): the k each metric prefers."""
    parts = None
    for name, maximise in METRICS.items():
        one = tuning.orderBy(F.desc(name) if maximise else F.asc(name), "k").limit(1).select(F.lit(name).alias("metric"), "k")
        parts = one if parts is None else parts.unionByName(one)
    return parts
