import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import blobs, lm_katz
from tests.llm.fixtures import SCHEMA, corpus, words

K = 5


def sequence(text):
    ws = words(text)
    return ["<s>", *ws, "</s>"] if ws else []


class BruteForce:
    """The model in dictionaries, evaluated by recursion."""

    def __init__(self, texts, order, least):
        self.order = order
        self.counts = {n: Counter() for n in range(1, order + 1)}
        for seq in map(sequence, texts):
            for i in range(1, len(seq)):
                for n in range(1, min(order, i + 1) + 1):
                    self.counts[n][tuple(seq[i - n + 1 : i + 1])] += 1
        self.tokens = sum(self.counts[1].values())
        self.kept, self.sums = {}, defaultdict(lambda: [0.0, 0.0])
        for n, counts in self.counts.items():
            often = Counter(counts.values())
            common = (K + 1) * often[K + 1] / often[1] if often[1] else 1.0
            d = {}
            for r in range(1, K + 1):
                x = ((r + 1) * often[r + 1] / (r * often[r]) - common) / (1 - common) if often[1] and often[r] and common < 1 else 1.0
                d[r] = x if 0 < x <= 1 else 1.0
            for gram, c in counts.items():
                if n < 3 or c >= least:
                    self.kept[gram] = d.get(c, 1.0) * c
            if n == 1 and self.tokens - sum(self.kept.values()) < 1e-9:
                self.tokens += 1
            if n > 1:
                for gram in counts:
                    if gram in self.kept:
                        self.sums[gram[:-1]][0] += self.kept[gram]
                        self.sums[gram[:-1]][1] += self.p(gram[1:])
        self.unknown = 1 - sum(v / self.tokens for g, v in self.kept.items() if len(g) == 1)

    def history(self, h):
        s, below = self.sums.get(h, (0.0, 0.0))
        count = self.counts[1][("</s>",)] if h == ("<s>",) else self.counts[len(h)][h]
        if not s:
            return count, 1.0
        total = s if 1 - below < 1e-12 else count + 1 if count - s < 1e-9 else count
        return total, 0.0 if 1 - below < 1e-12 else (1 - s / total) / (1 - below)

    def p(self, gram):
        if len(gram) == 1:
            return self.kept[gram] / self.tokens if gram in self.kept else self.unknown
        total, alpha = self.history(gram[:-1])
        return self.kept[gram] / total if gram in self.kept else alpha * self.p(gram[1:])

    def score(self, text):
        seq = sequence(text)
        grams = [tuple(seq[max(0, i - self.order + 1) : i + 1]) for i in range(1, len(seq))]
        return len(grams), sum(g not in self.kept for g in grams), sum(math.log(self.p(g)) for g in grams) if grams else None


def same(got, want):
    got = sorted(((r["n_tokens"], r["n_backoff"], r["log_prob"]) for r in got), key=repr)
    want = sorted(want, key=lambda x: repr((x[0], x[1], None if x[2] is None else round(x[2], 4))))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


@pytest.mark.parametrize(("order", "least", "chunk_bytes"), [(3, 2, 300), (3, 2, 6 << 20), (3, 1, 2000), (2, 2, 900), (4, 2, 2000), (1, 2, 5000)])
def test_scores_are_those_of_the_dictionaries(spark, order, least, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = BruteForce([r[1] for r in rows], order, least)
    same(lm_katz.score_documents(spark, docs, lm_katz.Katz(order=order, least_count=least, chunk_bytes=chunk_bytes)).collect(), [model.score(r[1]) for r in rows])


def test_any_text_is_scored_from_the_table(spark):
    rows = corpus(5)
    model = BruteForce([r[1] for r in rows], 3, 2)
    trained, _, _ = lm_katz.train(spark, spark.createDataFrame(rows, SCHEMA), lm_katz.Katz(chunk_bytes=1500))
    first = words(rows[0][1])
    others = [" ".join(first[5:20] + ["neverseen", "word"] + first[:9]), "neverseen", "", None, rows[3][1], " ".join(reversed(first)), "x"]
    docs = spark.createDataFrame(list(enumerate(others)), "doc_id int, text string")
    assert trained.figures.unknown == pytest.approx(model.unknown)
    same(lm_katz.score_texts(spark, trained, docs).collect(), [model.score(t) for t in others])


def test_every_history_sums_to_one(spark):
    rows = corpus(5)
    model = BruteForce([r[1] for r in rows], 3, 2)
    vocabulary = [g for g in model.counts[1]]
    histories = [h for h in model.sums if len(h) < 3][:60]
    for h in histories:
        assert sum(model.p(h + w) for w in vocabulary) + model.p((*h, "neverseen")) == pytest.approx(1)
    trained, _, _ = lm_katz.train(spark, spark.createDataFrame(rows, SCHEMA))
    for n in (2, 3):
        kept = sum(len(blobs.unsteps(r["a"])) for r in trained.table.where(f"part = 'm' and n_words = {n}").collect())
        sums = sum(len(blobs.unsteps(r["a"])) for r in trained.table.where(f"part = 'h' and n_words = {n}").collect())
        assert kept == sum(len(g) == n for g in model.kept)
        assert sums == sum(len(h) == n - 1 for h in model.sums)


def test_answers_hold_only_what_the_chunk_lacks(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    model, chunks, replies = lm_katz.train(spark, docs.coalesce(1))  # one chunk has all of every history
    assert chunks.count() == 1
    assert sum(r.where("part = 'p'").count() for r in replies) == 0
    assert model.table.where("part = 'h'").count() > 0
    model, chunks, replies = lm_katz.train(spark, docs.repartition(3), lm_katz.Katz(chunk_bytes=900))
    answers = [r for reply in replies for r in reply.where("part = 'p' and n_words = 2").collect()]
    some = [len(lm_katz._unsmall(r["c"], np.uint8)) for r in answers]
    assert sum(some) > 0
    assert all((lm_katz._unsmall(r["c"], np.uint8) == 2).sum() == len(lm_katz._unsmall(r["b"], np.float64)) for r in answers)  # no text of the corpus backs off from two words


def test_chunks_stay_where_they_were_written(spark, capsys):
    docs = spark.createDataFrame(corpus(5), SCHEMA)
    lm_katz.score_documents(spark, docs, lm_katz.Katz(chunk_bytes=900)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(chunk") == 1  # of the answers
    assert plan.count("Bucketed: true") == 1  # the chunks, read as they lie


def test_weights_come_back_from_one_number():
    s, below = np.array([0.0, 1.5, 3.0, 2.0, 4.0]), np.array([0.0, 0.3, 0.9, 1.0, 1.0 - 1e-13])
    count = np.array([4.0, 3.0, 3.0, 5.0, 4.0])
    value, sort = lm_katz._folded(s, below, count)
    assert sort.tolist() == [0, 0, 1, 2, 2]
    for need in (np.ones(5, dtype=bool), np.zeros(5, dtype=bool)):
        b, c = lm_katz._answer(value, sort, need)
        got = lm_katz._unfolded(*lm_katz._answered({"b": b, "c": c}, need), count)
        total, alpha = lm_katz.weights(s, below, count)
        assert (got[0] == total).all()
        assert (got[1] == np.where(need | (sort == 2), alpha, 1.0)).all()


def test_long_empty_and_clashing_tables(spark):
    assert lm_katz.score_documents(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b a b", "x", 1), (1, "a b a b", "x", 1), (None, "w " * 200_000, "y", 2)], "doc_id long, text string, chunk string, kind int")
    got = sorted(lm_katz.score_documents(spark, odd).collect(), key=lambda r: r["n_tokens"])
    assert [r["n_tokens"] for r in got] == [5, 5, 200_001]
    assert got[0] == got[1]


def test_codes_are_those_of_a_full_sort():
    rng = np.random.default_rng(2)
    cases = [rng.integers(0, 2**64, 5000, dtype=np.uint64) % np.uint64(m) for m in (3, 2**20, 2**63)]
    cases += [rng.integers(0, 2**64, 3000, dtype=np.uint64), np.array([5], dtype=np.uint64), np.array([2**64 - 1, 0, 2**64 - 1], dtype=np.uint64)]
    base = rng.integers(0, 2**40, 40, dtype=np.uint64) << np.uint64(24)
    cases.append((base[rng.integers(0, 40, 4000)] + rng.integers(0, 3, 4000, dtype=np.uint64)).astype(np.uint64))
    for keys in cases:
        want = np.unique(keys, return_index=True, return_inverse=True)
        got = lm_katz._codes(keys)
        assert (got[0] == want[0]).all()
        assert (got[2] == want[1]).all()
        assert (got[1] == want[2]).all()
