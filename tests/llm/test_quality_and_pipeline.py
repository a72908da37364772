import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import mixing, near_circulant, quality
from tests.llm.fixtures import SCHEMA, corpus, shingles, similarity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = quality.classify(spark, docs, labels.where(~held)).select("doc_id", F.col("quality").alias("said"))
    rows = got.join(labels.where(held), "doc_id")
    share = rows.agg(F.avg((F.col("said") == F.col("quality")).cast("double"))).first()[0]
    majority = rows.agg(F.avg("quality")).first()[0]
    kept = rows.where("quality = 1").agg(F.avg("said")).first()[0]
    assert share > max(majority, 1 - majority)
    assert share >= 0.85
    assert kept >= 0.9


def test_awkward_rows_are_scored(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA + ", p_good int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    assert quality.classify(spark, docs, labels).count() == len(rows)
    assert quality.keep_good(spark, docs, labels).columns == docs.columns
    assert quality.classify(spark, docs, labels.limit(0)).count() == len(rows)
    assert quality.classify(spark, docs.limit(0), labels).count() == 0
    only = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(spark, docs, only).count() == len(rows)


def test_scores_are_those_of_the_forward_pass():
    t = quality.Training(word_buckets=1 << 9, gram_buckets=1 << 9, pair_buckets=1 << 9, epochs=3)
    texts = pa.array(["good words here", "ça va très bien", "naïve 日本語 text", "", None, "a", "spam spam SPAM " * 50, "日本 ok"])
    features = list(quality.document_features(texts, t))
    model = quality.fit(features, np.array([1, 1, 0, 0, 1, 0, 0, 1]), t)
    folded = model.folded()
    scores = quality.score_texts(texts, folded.weights, folded.prior, t)
    for (at, share), score in zip(features, scores, strict=True):
        logits = (share @ model.vectors[at] if len(at) else np.zeros(t.dimensions)) @ model.layer + model.bias
        p = np.exp(logits - logits.max())
        assert score == pytest.approx(p[1] / p.sum(), abs=1e-4)


def test_features_are_words_character_n_grams_and_pairs():
    t = quality.Training(word_buckets=1 << 30, gram_buckets=1 << 30, pair_buckets=1 << 30)

    def count(text):
        """Distinct features by brute force, over characters."""
        words, found = text.split(), set()
        for w in words:
            found.add(("w", w))
            for n in t.gram_characters:
                found |= {("g", n, w[i : i + n]) for i in range(len(w) - n + 1)}
                if len(w) >= n - 1:
                    found |= {("a", n, w[: n - 1]), ("z", n, w[1 - n :])}
        return len(found | {("p", frozenset(x)) for x in itertools.pairwise(words)})

    texts = ["ça va très bien", "日本語 日本 語", "plain ascii text of some words", "ééé eee"]
    assert [len(f) for f, _ in quality.document_features(pa.array(texts), t)] == [count(x) for x in texts]


def test_the_bound_counts_labelled_documents_that_are_there(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(7, "another text of seven")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 8000)] + [(7, 1), (7, 0)], "doc_id long, quality int")
    t = quality.Training(sample_rows=90)
    rows = [{tuple(r) for r in quality._sample(docs.repartition(n), labels, t).collect()} for n in (1, 3)]
    assert rows[0] == rows[1]
    assert len(rows[0]) == 90
    whole = {tuple(r) for r in quality._sample(docs, labels, quality.Training()).collect()}
    assert len(whole) == 101
    assert [r for r in whole if r[0] == 7][0][1] == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(folder / str(k)))
        before, docs = docs, spark.read.parquet(str(folder / str(k)))
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).isEmpty() or after is stages[3][2]


def test_exact_stage_leaves_one_of_each_text(stages):
    _, before, after = stages[1]
    assert after.count() == before.select("text").distinct().count()
    first = before.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert after.select("doc_id", "text").exceptAll(first.select("doc_id", "text")).isEmpty()


def test_near_stage_leaves_no_near_pair_and_drops_nothing_else(stages):
    _, before, after = stages[2]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= near_circulant.PRODUCTION.threshold]
    assert sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
    touched = {x for p in near for x in p}
    assert set(sets) - touched <= kept


def test_mixing_stage_keeps_its_budget(stages):
    _, before, after = stages[3]
    count = lambda df: df.agg(F.sum(F.size(F.filter(F.split("text", r"[\t\n\u000b\f\r ]+"), lambda w: w != "")))).first()[0]
    assert count(after) <= corpus_pipeline.MIXING.budget * count(before) + 1
    assert after.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert isinstance(corpus_pipeline.MIXING, mixing.Mixing)


def test_packing_stage_holds_every_token(stages):
    _, before, after = stages[4]
    tokens = sum(len((r["text"] or "").split()) for r in before.collect())
    assert after.agg(F.sum("n_tokens")).first()[0] == tokens


def test_run_returns_the_windows(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages[4][2].count()
