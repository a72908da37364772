import dataclasses
import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import exact_mph, fingerprints, near, near_circulant
from tests.llm.fixtures import SCHEMA, corpus, shingles, similarity

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def true_pairs(texts, threshold):
    sets = {i: shingles(t) for i, t in texts.items()}
    return {(b, a) for a, b in itertools.combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= threshold}


def components(ids, pairs):
    label = {i: i for i in ids}
    for a, b in pairs:
        x, y = label[a], label[b]
        if x != y:
            label = {k: (min(x, y) if v in (x, y) else v) for k, v in label.items()}
    groups = defaultdict(set)
    for k, v in label.items():
        groups[v].add(k)
    return sorted(map(sorted, groups.values()))


def test_near_groups_are_those_of_all_pairs(spark):
    texts = texts_of(spark)
    want = [g for g in components(texts, true_pairs(texts, near_circulant.PRODUCTION.threshold)) if len(g) > 1]
    rows = near_circulant.near_dedup_report(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect()
    got = sorted(sorted(r["members"]) for r in rows)
    assert sorted(x for g in got for x in g) == sorted(texts)
    found = sum(g in got for g in want)
    assert want
    assert found >= 0.9 * len(want)
    assert all(r["doc_id"] == min(r["members"]) for r in rows)
    joined = {frozenset(p) for g in got for p in itertools.combinations(g, 2)}
    allowed = {frozenset(p) for g in want for p in itertools.combinations(g, 2)}
    assert joined <= allowed


@pytest.mark.parametrize("block_nodes", [3, 256])
def test_classes_and_links_are_those_of_all_pairs(spark, block_nodes):
    banding = dataclasses.replace(fingerprints.PRODUCTION, block_nodes=block_nodes)
    texts = texts_of(spark)
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    pairs = true_pairs(texts, banding.threshold)
    pairs |= {(b, a) for a, b in itertools.combinations(sorted(texts), 2) if sets[a] and sets[a] == sets[b]}
    rows = fingerprints.near_classes(spark, spark.read.parquet(f"{SF}/documents.parquet"), banding).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    wanted = {i: g[0] for g in components(texts, pairs) for i in g}
    assert sum(r["class_id"] == wanted[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all(wanted[r["class_id"]] == wanted[r["doc_id"]] for r in rows)
    assert all(r["set_id"] == min(i for i in texts if sets[i] == sets[r["doc_id"]]) for r in rows if sets[r["doc_id"]])
    linked = {frozenset((sets[a], sets[b])) for a, b in pairs if sets[a] != sets[b]}
    true_links = {s: sum(s in p for p in linked) for s in sets.values()}
    got = {sets[r["doc_id"]]: r["n_links"] for r in rows}
    assert all(n <= true_links[s] for s, n in got.items())
    assert sum(got.values()) >= 0.9 * sum(true_links.values()) > 0


@pytest.mark.parametrize("block_nodes", [2, 256])
def test_copies_are_in_the_class_of_their_texts(spark, block_nodes):
    base = [f"w{i}" for i in range(200)]
    one, two, three = (" ".join(base[:n]) for n in (200, 190, 180))
    rows = [(i, (one, two, three)[i % 3]) for i in range(15)] + [(20, "alone in the world it is"), (21, one), (21, one), (None, two), (30, ""), (31, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(3)
    banding = dataclasses.replace(fingerprints.PRODUCTION, block_nodes=block_nodes)
    got = sorted((tuple(r) for r in fingerprints.near_classes(spark, docs, banding).collect()), key=repr)
    wanted = [(i, 0, i % 3, 2) for i in range(15)] + [(20, 20, 20, 0), (21, 0, 0, 2), (21, 0, 0, 2), (None, 0, 1, 2), (30, 30, 30, 0), (31, 31, 31, 0)]
    assert got == sorted(wanted, key=repr)


def test_common_counts_in_steps(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint32)) for n in (1, 40, 200, 500)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]
    for step in (1, 7, 1 << 21):
        monkeypatch.setattr(near, "_STEP", step)
        assert near.common_counts(sets, sets[1:]).tolist() == want


def test_disjoint_long_texts_share_no_band():
    rng = np.random.default_rng(9)
    both = rng.permutation(np.unique(rng.integers(0, 2**32, 4_000_000, dtype=np.uint32)))
    half = len(both) // 2
    for sign in (near_circulant.circulant_signer(100), fingerprints.universal_signer(100)):
        a, b = sign(both, np.array([0, half]))
        assert not (a == b).any()


def test_recall_of_both_signatures_at_the_threshold():
    rng = np.random.default_rng(3)
    for sign in (near_circulant.circulant_signer(100), fingerprints.universal_signer(100)):
        hits, same = 0, []
        for _ in range(300):
            common, own = rng.integers(0, 2**32, 240, dtype=np.uint32), rng.integers(0, 2**32, (2, 60), dtype=np.uint32)
            a, b = sign(np.concatenate([common, own[0], common, own[1]]), np.array([0, 300]))  # Jaccard 240 / 360
            same.append((a == b).mean())
            hits += (a.reshape(25, 4) == b.reshape(25, 4)).all(axis=1).any()
        assert np.mean(same) == pytest.approx(2 / 3, abs=0.03)
        assert hits >= 0.9 * 300


def test_awkward_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA + ", node string").repartition(2)
    kept = near_circulant.near_dedup(spark, docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1
    assert 30 not in ids
    assert 31 not in ids
    assert {34, 35, 36, 37, 38} <= set(ids)
    assert ids.count(3) == 1
    exact = exact_mph.exact_dedup(spark, docs)
    assert exact.columns == docs.columns
    left = [r["text"] for r in exact.collect()]
    assert len([t for t in left if t is not None]) == len({r[1] for r in rows if r[1] is not None})
    assert left.count(None) == 3
    empty = docs.limit(0)
    assert near_circulant.near_dedup(spark, empty).count() == near_circulant.near_dedup_report(spark, empty).count() == 0
    assert fingerprints.near_classes(spark, empty).count() == exact_mph.exact_dedup_report(spark, empty).count() == 0


def test_many_copies_and_a_chain_make_one_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    chain = [" ".join(f"w{i}" for i in range(s, s + 100)) for s in range(0, 60, 10)]
    rows = [(i, base) for i in range(2000)] + [(3000 + i, t) for i, t in enumerate(chain)]
    report = near_circulant.near_dedup_report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_members"], len(r["members"])) for r in report] == [(0, 2006, 2006)]


def test_large_groups_are_listed_in_pieces(spark):
    rows = spark.range(250).selectExpr("'g' as `group`", "0L as kept", "id as doc_id", "250L as size")
    listed = near.member_lists(rows, chunk_rows=100).collect()
    assert len(listed) == 3
    assert sorted(x for r in listed for x in r["members"]) == list(range(250))


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    hashed = exact_mph.PerfectHash.build(keys)
    assert sorted(hashed.slots(keys)) == list(range(5000))
    again = exact_mph.PerfectHash.from_bytes(*hashed.to_bytes())
    assert (again.slots(keys) == hashed.slots(keys)).all()
    with pytest.raises(ValueError, match="distinct"):
        exact_mph.PerfectHash.build(np.concatenate([keys, keys[:1]]))


def test_an_outside_history_removes_its_texts(spark):
    docs = spark.createDataFrame([(5, "old"), (6, "new"), (7, "new"), (8, None)], "doc_id long, text string")
    history = spark.createDataFrame([(1, "old"), (2, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in exact_mph.exact_dedup(spark, docs, history).collect())) == [6, 8]


def test_a_hot_bucket_is_compared_in_blocks(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # distinct texts around one, some of them too far from the leader
        t = list(base)
        for k in rng.integers(0, 120, int(rng.integers(1, 12))):
            t[k] = f"x{rng.integers(1000)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = [sorted(map(tuple, near_circulant.near_dedup_report(spark, docs, dataclasses.replace(near_circulant.PRODUCTION, block_nodes=n)).collect())) for n in (4, 256)]
    assert whole[0] == whole[1]
    links = [sorted(map(tuple, fingerprints.near_classes(spark, docs, dataclasses.replace(fingerprints.PRODUCTION, block_nodes=n)).collect())) for n in (4, 256)]
    assert links[0] == links[1]
    sets = [shingles(t) for t in texts]
    most = [sum(a is not b and similarity(a, b) >= 0.6 for b in sets) for a in sets]
    assert all(r[3] <= n for r, n in zip(links[0], most, strict=True))
    assert sum(r[3] for r in links[0]) >= 0.9 * sum(most)


def test_hot_digests_are_looked_up_in_copies_of_their_shard(spark):
    old = spark.createDataFrame([(1, "hot"), (2, "cold")], "doc_id long, text string")
    new = spark.range(10, 3010).selectExpr("id as doc_id", "case when id % 3 = 0 then concat('own', id) else 'hot' end as text")
    ws = exact_mph.Workspace(spark, "test")
    digest = lambda df: ws.table(df.select("doc_id", exact_mph.text_digest(F.col("text")).alias("digest")), df.columns[0] + str(df.count()))
    _, index = exact_mph.build_index(ws, digest(old), 4)
    found = exact_mph.look_up(digest(new), index, 4, task_rows=100).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(10, 3010))
    assert all(r["member"] == (r["doc_id"] % 3 > 0) and r["winner"] == (1 if r["member"] else None) for r in found)


def test_exact_copies_of_string_ids(spark):
    rows = [("b", "x"), ("a", "x"), ("c", "y"), (None, "x"), ("d", None), ("e", ""), ("f", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(r["doc_id"] for r in exact_mph.exact_dedup(spark, docs).collect()) == ["a", "c", "d", "e"]
    report = {r["doc_id"]: (r["n_members"], set(r["members"])) for r in exact_mph.exact_dedup_report(spark, docs).collect()}
    assert report == {"a": (3, {"a", "b", None}), "c": (1, {"c"}), "d": (1, {"d"}), "e": (2, {"e", "f"})}
