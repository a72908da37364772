"""The chunked term table against the rows of tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.config import Preparation
from lexmill.operators import chd, chunks, concordance, contingency, dtm, lexicon, phrases, segment, topics
from lexmill.plans import queries as core
from lexmill.streaming import counts
from tests.comparing import compare, connect

PREP = Preparation(stopwords=("zz",), synonyms={"b": "a"}, min_occurrences=3, expressions={"c d": "c_d"})
TEXTS = ["a b c d e. a a f", "b f g zz. h", "", "c d. a e e", "zz", "q r. r", None]


@pytest.fixture(params=[3, 1_000_000])
def tables(spark, monkeypatch, request):
    """Segments' tokens and their chunks, of a few tokens or of all."""
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", request.param)
    rows = [(i, t, "x" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    segs = segment.segments(docs, size=3, keep=("lang", "source"))
    words = lexicon.keyed_lexicon(spark.createDataFrame([("e", "ee", "nom"), ("q", "q", "art")], "form string, lemma string, pos string"))
    active = segment.active_forms(segs, words, PREP, keep=("lang", "source"))
    return active, chunks.chunked(segs, words, PREP, ("lang", "source"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_chunks_have_the_rows_of_the_term_table(tables):
    active, made = tables
    rare = chunks.rare_codes(made, 3)
    assert rows(chunks.form_stats(made), "form", "freq", "n_uce") == rows(dtm.form_stats(active), "form", "freq", "n_uce")
    assert rows(chunks.pairs(made, rare), "uce_id", "form") == rows(dtm.dtm(active, 3), "uce_id", "form")
    assert rows(chunks.row_sizes(made, rare), "uce_id", "n_forms") == rows(dtm.row_sizes(dtm.dtm(active, 3)), "uce_id", "n_forms")


def test_profile_and_filled_segments_by_group(tables):
    active, made = tables
    cells = dtm.dtm(active, 3).join(active.select("uce_id", "lang", "source").distinct(), "uce_id")
    keep = ("lang", "source")
    want = cells.groupBy("form", *keep).agg(F.count("*").alias("n"))
    assert rows(chunks.profile(made, 3, keep), "form", *keep, "n") == rows(want, "form", *keep, "n")
    want = cells.groupBy(*keep).agg(F.count_distinct("uce_id").alias("n_filled"))
    assert rows(chunks.filled(made, 3, keep), *keep, "n_filled") == rows(want, *keep, "n_filled")


def test_the_profile_is_shuffled_once_and_by_form(tables):
    plan = chunks.profile(tables[1], 3, ("lang", "source"))._jdf.queryExecution().executedPlan().toString()
    assert {x.split("(")[1].split("#")[0] for x in plan.splitlines() if "Exchange hashpartitioning" in x for x in [x.split("hashpartitioning")[1]]} == {"form"}
    assert plan.count("Exchange hashpartitioning") == 1


def test_specificities_of_cells_are_those_of_the_whole_table(spark):
    cells = [("v", f"f{i}", p, k) for i in range(30) for j, p in enumerate("abc") if (k := (i * 7 + j * 5) % 11)] + [("w", "f0", "a", 2)]
    cells = spark.createDataFrame(cells, "variable string, form string, part string, k long")
    grid = contingency.part_grid(cells).select("variable", "form", "part", "k")
    assert {r["variable"] for r in grid.collect()} == {"v"}
    columns = ("variable", "form", "part", "score", "sign", "observed", "expected")
    found = rows(contingency.specificities_of_cells(cells, 0.5), *columns)
    assert found == rows(contingency.specificities(grid, 0.5), *columns)
    assert found


@pytest.fixture
def talk(spark):
    texts = [f"The big Cat{i % 4} sat on A mat. big cat{i % 3} ran NATO home; see the {'very ' * (i % 3)}old dog{i % 5} run" for i in range(40)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([("the",), ("on",), ("a",)], "token string")


def test_no_phrase_that_is_among_the_best_is_passed_over(talk, spark):
    docs, stop = talk
    table, n = phrases.spoken(docs).persist(), spark.createDataFrame([(120,)], "n_sent long")
    scored = phrases.terms(table, n, stop).persist()
    whole = [tuple(r) for r in phrases.best_phrases(table, scored, 3, 10**6).collect()]
    assert len(whole) > 20
    for most in (1, 3, 10):
        some = [tuple(r) for r in phrases.best_phrases(table, scored, 3, most).collect()]
        assert some[:most] == whole[:most]
        assert len(some) < len(whole)


def test_key_phrases_do_not_depend_on_the_chunks(talk, monkeypatch):
    docs, stop = talk
    whole = [tuple(r) for r in concordance.key_phrases(docs, stop).collect()]
    monkeypatch.setattr(phrases, "CHUNK_TOKENS", 1)
    assert [tuple(r) for r in concordance.key_phrases(docs.coalesce(1), stop).collect()] == whole


@pytest.mark.parametrize("tokens", [1, 10**6])
def test_cuts_by_chunks_equal_those_of_the_rows(spark, monkeypatch, tokens):
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", tokens)
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(1, 2 + i % 5)) + ".") for i in range(60)], "doc_id long, text string")
    segs = segment.segments(docs, size=2).withColumns({"lang": F.lit("x")})
    words = lexicon.keyed_lexicon(spark.createDataFrame([], "form string, lemma string, pos string"))
    pairs = dtm.dtm(segment.active_forms(segs, words, Preparation()), 3)
    units = segs.select("uce_id", F.size("tokens").alias("k"))
    want = chd.cut_scores(chd.positions(units, "k", "uce_id"), pairs).orderBy("pos").collect()
    placed = segs.repartitionByRange(3, F.size("tokens"), "uce_id").sortWithinPartitions(F.size("tokens"), "uce_id")
    found = chd.cut_scores_of_chunks(chunks.chunked(placed, words, Preparation()), 3).orderBy("pos").collect()
    assert [r["pos"] for r in found] == [r["pos"] for r in want]
    assert [r["chi2"] for r in found] == pytest.approx([r["chi2"] for r in want])


def test_streamed_counts_stay_off_the_driver(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a b a",), ("b c",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(counts, "to_memory", None)
    found = counts.to_table(counts.form_counts(counts.read_table(spark, str(tmp_path), "documents")))
    assert rows(found, "form", "n") == [("a", 2), ("b", 2), ("c", 1)]
    assert len(found.inputFiles()) > 0


def test_topics_read_kept_vectors_in_few_parts(spark):
    table = spark.createDataFrame([(i, f"f{(i * j) % 9}", 1 + j % 2) for i in range(40) for j in range(1, 5)], "doc_id long, form string, n long").repartition(20)
    _, vocabulary, vectors = topics.fit(table, iterations=2)
    assert vectors.storageLevel.useMemory
    assert vectors.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    total = {r["form"]: r["n"] for r in table.groupBy("form").agg(F.sum("n").alias("n")).collect()}
    assert vocabulary.vocabulary == sorted(total, key=lambda x: (-total[x], x))


def one_by_one(side, rows, n_forms, min_size, passes):
    """Relocation, a row at a time."""
    side = side.copy()
    for _ in range(passes):
        moved = False
        for i in range(len(rows)):
            other = side.copy()
            other[i] = not other[i]
            if (side == side[i]).sum() - 1 >= min_size and chd.bipartition_chi2(other, rows, n_forms) > chd.bipartition_chi2(side, rows, n_forms) + 1e-9:
                side, moved = other, True
        if not moved:
            break
    return side


@pytest.mark.parametrize("seed", range(6))
def test_relocation_by_blocks_is_that_row_by_row(seed):
    rng = np.random.default_rng(seed)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(90)]
    side = rng.random(90) < 0.5
    assert (chd.relocate_rows(side, rows, 12, 5, 4) == one_by_one(side, rows, 12, 5, 4)).all()


@pytest.mark.parametrize("block", [7, 10**6])
def test_classes_in_one_task_are_those_by_joins(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    cells = {(f"u{i:02d}", f"f{j}") for i in range(36) for j in range(15) if rng.random() < (0.6 if i % 3 == j % 3 else 0.08)} | {(f"u{i:02d}", "f0") for i in range(36)}
    pairs = spark.createDataFrame([*sorted(cells), ("u00", "f0")], "uce_id string, form string").repartition(3)
    monkeypatch.setattr(chd, "BLOCK_CELLS", block)
    one = chd.classify(pairs)
    monkeypatch.setattr(chd, "MAX_TASK_CELLS", 0)
    other = chd.classify(pairs)
    assert rows(one.assign, "uce_id", "class") == rows(other.assign, "uce_id", "class")
    plain = lambda df: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, df.collect()), key=repr)]
    assert plain(one.tree) == plain(other.tree)
    assert len(one.tree.collect()) == 5
    assert plain(one.terms) == plain(other.terms)


@pytest.mark.parametrize("tokens", [50, 10**6])
@pytest.mark.parametrize("name", ["dtm_pairs", "count_matrix", "form_class_table", "signed_chi2_terms", "dtm_row_sizes"])
def test_rows_of_one_document_count_as_one(spark, tmp_path, monkeypatch, name, tokens):
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", tokens)
    old = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    old.unionByName(old.where("doc_id % 3 = 0")).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(core.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), core.oracle_sql()[name]) == ""
