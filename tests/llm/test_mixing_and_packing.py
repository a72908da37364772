import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import mixing, packing
from tests.llm.fixtures import SCHEMA, corpus, prose


@pytest.mark.parametrize("tokens", [[100, 10, 1], [5, 5], [7], [1000, 3, 3, 3]])
def test_exponent_meets_its_target(tokens):
    limited = mixing.Mixing(max_repetition=1.5)
    t = mixing.bisect_exponent(tokens, limited)
    most = lambda t: max(sum(tokens) * w / n for w, n in zip(mixing.weights(tokens, t), tokens, strict=True))
    assert sum(mixing.weights(tokens, t)) == pytest.approx(1)
    assert most(t) <= 1.5 + 1e-9
    if t > 0:
        assert most(t) == pytest.approx(1.5, abs=1e-6)
    full = mixing.entropy(mixing.weights(tokens, 0))
    least = mixing.entropy(mixing.weights(tokens, 1))
    goal = (full + least) / 2
    t = mixing.bisect_exponent(tokens, mixing.Mixing(target_entropy=goal))
    assert mixing.entropy(mixing.weights(tokens, t)) == pytest.approx(goal, abs=1e-6)


def test_quotas_are_met_by_whole_epochs_and_blocks(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 6)), "abbbbbbbbb"[i % 10]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.Mixing(max_repetition=2.0, block_tokens=400)
    _, _, summary = mixing.plan(spark, docs, m)
    got = mixing.mix(spark, docs, m).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    times = Counter(r["doc_id"] for r in got)
    for s in summary:
        taken = sum(size[i] * n for i, n in times.items() if source[i] == s["source"])
        assert s["quota"] - max(size.values()) < taken <= s["quota"]
        own = {i: times[i] for i in source if source[i] == s["source"]}
        assert set(own.values()) <= {s["epochs"], s["epochs"] + 1}
    orders = defaultdict(dict)
    for r in got:
        orders[r["source"], r["epoch"]][r["block"]] = r["block_rank"]
    for ranks in orders.values():
        assert len(set(ranks.values())) == len(ranks)
    assert orders["a", 0] != {b: orders["a", 1].get(b) for b in orders["a", 0]}


def test_mixing_of_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in corpus()], SCHEMA + ", h int, block int")
    rows = mixing.mix_rows(spark, docs)
    assert rows.columns == docs.columns
    assert rows.count() > 0
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    nothing = docs.where("text is null")
    assert mixing.mix(spark, nothing).count() == 0


def brute_force(lengths, document_end, p):
    total, n = np.concatenate([[0], np.cumsum(lengths)]), len(lengths)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            size = total[j] - total[i]
            cost = p.pad * max(0, p.capacity - size) + p.truncate * max(0, size - p.capacity) + (0 if document_end[j - 1] else p.cut)
            best[j] = min(best[j], best[i] + cost)
    return best[n]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    p = packing.Packing(capacity=20, truncate=int(rng.integers(0, 9)), cut=int(rng.integers(0, 9)))
    lengths = rng.integers(1, 30 if seed % 3 else 9, 60)
    ends = rng.random(60) < 0.3
    ends[-1] = True
    cuts, penalty = packing.best_cuts(lengths, ends, p)
    assert penalty == brute_force(lengths, ends, p)
    start, again = 0, 0
    for stop in cuts:
        size = int(lengths[start:stop].sum())
        again += p.pad * max(0, p.capacity - size) + p.truncate * max(0, size - p.capacity) + (0 if ends[stop - 1] else p.cut)
        start = stop
    assert again == penalty


def test_sentences_add_up_to_the_tokens():
    texts = ["One two. Three\nfour five! six", "", "...", "a.b c", None]
    assert [x.tolist() for x in packing.sentence_lengths(pa.array(texts))] == [[2, 1, 2, 1], [], [1], [2], []]


def test_every_token_is_in_one_window(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", block int")
    windows = packing.pack_windows(spark, docs, packing.Packing(capacity=64, block_docs=8)).collect()
    seen = defaultdict(list)
    for w in sorted(windows, key=lambda r: (r["block"] is None, r["block"] or 0, r["window"])):
        assert w["n_tokens"] == sum(s["stop"] - s["start"] for s in w["spans"])
        assert w["padding"] == max(0, 64 - w["n_tokens"])
        assert w["truncated"] == max(0, w["n_tokens"] - 64)
        for s in w["spans"]:
            seen[s["doc_id"]].append((s["start"], s["stop"]))
    for i, text in {r[0]: r[1] for r in rows if r[0] not in (3, None)}.items():
        n, at = len((text or "").split()), 0
        for a, b in seen.get(i, []):
            assert a == at
            at = b
        assert at == n
    assert sum(w["n_tokens"] for w in windows) == sum(len((r[1] or "").split()) for r in rows)
    assert packing.pack_windows(spark, docs.limit(0)).count() == 0


def test_a_far_id_does_not_fill_a_block(spark):
    rows = [(i, "One two three.") for i in range(500)] + [(10**12, "far."), (-(2**63), "least."), (2**63 - 1, "most."), (None, "none.")]
    windows = packing.pack_windows(spark, spark.createDataFrame(rows, "doc_id long, text string"), packing.Packing(capacity=30, block_docs=50)).collect()
    windows.sort(key=lambda r: (r["block"], r["window"]))
    assert {r["block"] for r in windows} == set(range(11))
    assert [i for r in windows for i in r["doc_ids"]] == [-(2**63), *range(500), 10**12, 2**63 - 1, None]


def test_ids_of_any_type_in_their_order(spark):
    rows = [(f"d{i:03}", f"Text {i} ends.") for i in range(40)] + [(None, "last.")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    windows = sorted(packing.pack_windows(spark, docs, packing.Packing(capacity=9, block_docs=10)).collect(), key=lambda r: (r["block"], r["window"]))
    assert [i for r in windows for i in r["doc_ids"]] == [r[0] for r in rows]


def test_windows_follow_the_mixture(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(1, 4)), "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, text string, source string").repartition(5)
    m = mixing.Mixing(budget=0.9, max_repetition=1.0, block_tokens=300)
    mixing.mix_rows(spark, docs, m).write.parquet(str(tmp_path / "mixed"))
    windows = packing.pack_windows(spark, spark.read.parquet(str(tmp_path / "mixed")), packing.Packing(block_docs=40), packing.stored_place()).collect()
    seen = list(dict.fromkeys(i for r in sorted(windows, key=lambda r: (r["block"], r["window"])) for i in r["doc_ids"]))
    taken = {r["doc_id"]: r for r in mixing.mix(spark, docs, m).collect()}
    assert set(seen) == set(taken)
    places = defaultdict(list)
    for at, i in enumerate(seen):
        places[taken[i]["source"], taken[i]["block"]].append(at)
    assert all(x == list(range(x[0], x[0] + len(x))) for x in places.values())  # a block's documents stand together
    for source in "ab":
        order = sorted((x[0], taken[seen[x[0]]]["block_rank"]) for (s, _), x in places.items() if s == source)
        assert [rank for _, rank in order] == sorted(rank for _, rank in order)
    assert len(places) > 8
    assert seen != sorted(seen)
