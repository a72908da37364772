"""Operators that SQL can't express, and the corners of those that it can, against brute force."""

import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.config import Preparation
from lexmill.errors import CorpusError, LexicalError, MatrixError
from lexmill.functions import numeric
from lexmill.functions import text as X
from lexmill.operators import ca, chd, concordance, contingency, dtm, graph, labbe, lexicon, saturation, segment, sentiment, topics
from lexmill.sinks import export
from lexmill.sources import dictionaries, documents, prepared


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Ab 3.5 x² a_b", ["ab", "x²", "a", "b"]), ("", []), ("été Öl", ["été", "öl"]), ("12 34", []), (None, None)],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, X.tokens) == tokens


def test_sentences_split_at_stops_and_line_ends(spark):
    assert one(spark, "One. Two!? 3.5\r\nlast;... ", X.sentences) == ["One.", "Two!", "3.", "5", "last;"]


def test_turns_of_dropped_speakers_go(spark):
    texts = {
        "intro\nModerador 2: hi\nmore\nAnna: yes\nno": ("intro\nyes\nno", 1),
        "plain\ntext": ("plain\ntext", 0),
        "Para mim, foi assim: comer bem.\nMediadora: e?\nsim": ("Para mim, foi assim: comer bem.", 1),
        "  PALESTRANTE :  a\r\nb\r\n\r\nÉva M. 3: c\n\nd\n": ("c\n\nd", 1),
        "Facilitador: a\nCoordenador: b\nAnna: c\nentrevistadora: d\ne": ("c", 3),
        "Anna:no blank\nModerador:\nx": ("Anna:no blank\nModerador:\nx", 0),
        "Anna: a\n\n\nBea: b": ("a\n\n\nb", 0),
        "\nAnna: a": ("\na", 0),
        "": ("", 0),
        None: (None, 0),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kept, dropped = X.filter_turns(F.col("text"))
    rows = df.select("text", kept.alias("t"), dropped.alias("n")).collect()
    assert {r["text"]: (r["t"], r["n"]) for r in rows} == texts


def test_markers_and_labels_go(spark):
    for text, clean in {
        "a Participante 3 b": "a b", "fala moderador 2": "fala", "ININTELIGÍVEL x ininteligível": "x", "moderadores ficam": "moderadores ficam",
        "a (riso] b [x) c": "a b c", "Entrevistadora diz inaudivel": "diz", "incompreensível, sim": ", sim",
    }.items():
        assert one(spark, text, X.clean_transcript) == clean


def test_keys_of_parts_of_speech(spark):
    words = spark.createDataFrame([(x, x, x) for x in ("num", "conj", "nom_sup", "odd", "aux", "NOM", "pre_x")], "form string, lemma string, pos string")
    assert {r["form"]: r["key"] for r in lexicon.keyed_lexicon(words).collect()} == {"num": 1, "conj": 2, "nom_sup": 2, "odd": 1, "aux": 2, "NOM": 1, "pre_x": 2}
    keys = spark.createDataFrame([("con", 1), ("NUM", 2), ("odd", 2)], "pos string, key int")
    got = {r["form"]: r["key"] for r in lexicon.keyed_lexicon(words, keys).collect()}
    assert (got["conj"], got["num"], got["odd"], got["aux"]) == (1, 2, 2, 2)


@pytest.mark.parametrize("upper", [True, False])
def test_hypergeometric_tails_of_large_counts(spark, upper):
    from math import exp, lgamma, log

    def choose(n, k):
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    rows = [(5, 100, 20, 30), (60_000, 1_000_000, 100_000, 500_000), (50_100, 1_000_000, 100_000, 500_000), (49_900, 1_000_000, 100_000, 500_000), (0, 50, 5, 7), (7, 50, 7, 7)]
    rows = [r for r in rows if (r[0] >= r[2] * r[3] / r[1]) == upper]
    df = spark.createDataFrame(rows, "k long, total long, row long, column long")
    for r in df.select("*", numeric.hypergeometric_tail(*[F.col(c) for c in ("k", "total", "row", "column")], upper=upper).alias("p")).collect():
        side = range(r["k"], min(r["row"], r["column"]) + 1) if upper else range(max(0, r["column"] - r["total"] + r["row"]), r["k"] + 1)
        logs = [choose(r["row"], i) + choose(r["total"] - r["row"], r["column"] - i) - choose(r["total"], r["column"]) for i in side]
        top = max(logs)
        want = top + log(sum(exp(x - top) for x in logs))
        assert (log(r["p"]) if r["p"] > 0 else want) == pytest.approx(want, abs=1e-5)


def test_expressions_longest_first_from_the_left(spark):
    table = {"a b": "AB", "a b c": "ABC", "c d": "CD", "d e": "DE"}
    words = "a b c d e a b x c d e".split()
    df = spark.createDataFrame([(words,), ([],), (None,), (["a"],)], "w array<string>")
    got = [r[0] for r in df.select(lexicon.merge_expressions(F.col("w"), table)).collect()]
    assert got == [["ABC", "DE", "AB", "x", "CD", "e"], [], None, ["a"]]


def test_synonym_chains_and_cycles():
    assert lexicon.close_synonyms({"a": "b", "b": "c"}) == {"a": "c", "b": "c"}
    assert lexicon.close_synonyms({"a": "b", "b": "a"}) == {"a": "a", "b": "b"}
    assert lexicon.close_synonyms({"a": "b", "b": "c", "c": "b"})["a"] == "b"


def test_synonym_tables_of_long_chains(spark):
    pairs = {f"w{i:03}": f"w{i + 1:03}" for i in range(150)} | {"x": "y", "y": "z", "z": "y"}
    got = {r["variant"]: r["canonical"] for r in lexicon.close_synonyms_table(spark.createDataFrame(list(pairs.items()), "variant string, canonical string")).collect()}
    assert got["w000"] == got["w149"] == "w150"
    assert (got["x"], got["y"], got["z"]) == ("y", "y", "z")


def test_phrases_that_are_alike_are_listed_once(spark):
    ranked = spark.createDataFrame([("long phrase here", 0.1), ("long phrase hero", 0.2), ("other", 0.3), ("others", 0.4)], "phrase string, score double").orderBy("score")
    assert [r["phrase"] for r in concordance._unlike(ranked, 3, 0.9).collect()] == ["long phrase here", "other", "others"]


def test_segments_keep_sentences_whole(spark):
    docs = spark.createDataFrame([(1, "a b c. d e. f g h i. j."), (2, ""), (3, None), (4, "x " * 90 + ".")], "doc_id long, text string")
    rows = segment.segments(docs, size=4).orderBy("uce_id").collect()
    assert [(r["uci_id"], r["uce_index"], len(r["tokens"])) for r in rows] == [(1, 0, 5), (1, 1, 4), (1, 2, 1), (4, 0, 90)]


def test_rules_of_activity_in_order(spark):
    words = spark.createDataFrame([(w,) for w in ("anonx", "of_the", "a", "stop", "fast", "who", "run")], "token string")
    known = lexicon.keyed_lexicon(spark.createDataFrame([("fast", "fast", "adv"), ("run", "run", "ver"), ("a", "a", "art")], "form string, lemma string, pos string"))
    prep = Preparation(stopwords=("stop", "of_the"), expressions={"of the": "of_the"}, adverbs_active=False, unknown_active=False, min_token_length=2, anonymous_prefix="anon")
    got = {r["token"]: r["active"] for r in lexicon.lexed(words, known, prep).collect()}
    assert got == {"anonx": False, "of_the": True, "a": False, "stop": False, "fast": False, "who": False, "run": True}


def test_negation_turns_three_tokens_of_its_sentence(spark):
    text = ["no x y good", "no x y z good", "no no good", "no. good", "good no", ""]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    empty = lexicon.keyed_lexicon(spark.createDataFrame([], "form string, lemma string, pos string"))
    rows = sentiment.score(docs, empty, spark.createDataFrame([("good", 1)], "lemma string, polarity int"), ("no",)).orderBy("doc_id").collect()
    assert [r["score"] for r in rows] == [-1, 1, -1, 1, 1, 0]


# ---- clustering of segments -----------------------------------------------------------------


def blocks(spark, n=20):
    rows = [(f"u{i:02d}", f"{'ab'[i >= n // 2]}{j}") for i in range(n) for j in range(4) if (i * 7 + j * 3) % 5]
    return spark.createDataFrame(rows, "uce_id string, form string")


def random_cells(n, v, seed):
    rng = np.random.default_rng(seed)
    return (rng.random((n, v)) < 0.35).astype(int)


def brute_chi2(side, x):
    left, right = x[side].sum(0), x[~side].sum(0)
    n, total = x.sum(), 0.0
    for part in (left, right):
        expected = part.sum() * (left + right) / n
        ok = expected > 0
        total += ((part[ok] - expected[ok]) ** 2 / expected[ok]).sum()
    return total


@pytest.mark.parametrize("range_rows", [1_000_000, 4])
def test_cut_scores_equal_the_chi_square_of_every_cut(spark, monkeypatch, range_rows):
    monkeypatch.setattr(chd, "RANGE_ROWS", range_rows)
    x = random_cells(15, 7, 3)
    cells = spark.createDataFrame([(f"u{i:02d}", f"f{j}") for i, j in zip(*np.nonzero(x), strict=True)], "uce_id string, form string")
    ordered = spark.createDataFrame([(f"u{i:02d}", i + 1) for i in range(15)], "uce_id string, pos int")
    got = {r["pos"]: r["chi2"] for r in chd.cut_scores(ordered, cells).collect()}
    for k in range(1, 15):
        assert got[k] == pytest.approx(brute_chi2(np.arange(15) < k, x), abs=1e-9)


def test_the_axis_of_close_eigenvalues_converges():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 80)) < 0.08).astype(int)
    x[:150, :40] |= rng.random((150, 40)) < 0.1
    x[150:, 40:] |= rng.random((150, 40)) < 0.1
    x[:, 0] = x[0, :] = 1
    row, form = np.nonzero(x)
    p = x / x.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    e = np.linalg.svd(s)[2][0]
    got = chd.leading_vector(row, form, 300, 80, 1e-9)
    assert abs(got @ e) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("most_on_driver", [3000, 2])
def test_first_axis_is_that_of_the_singular_value_decomposition(spark, monkeypatch, most_on_driver):
    monkeypatch.setattr(chd, "MAX_LOCAL_CELLS", most_on_driver)
    monkeypatch.setattr(chd, "BLOCK", 3)
    x = random_cells(12, 6, 5)
    x[:6, :3] |= 1
    x[6:, 3:] |= 1
    x[:5, 4:] = 0
    cells = spark.createDataFrame([(f"u{i:02d}", f"f{j}") for i, j in zip(*np.nonzero(x), strict=True)], "uce_id string, form string")
    got = np.array([r["axis"] for r in chd.first_axis(cells).orderBy("uce_id").collect()])
    p = x / x.sum()
    r, c = p.sum(1), p.sum(0)
    u, _, _ = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))
    axis = u[:, 0] / np.sqrt(r)
    assert abs(np.corrcoef(got, axis)[0, 1]) == pytest.approx(1, abs=1e-8)


def test_relocation_raises_chi_square_and_keeps_sizes():
    x = random_cells(14, 6, 9)
    rows = [np.flatnonzero(r) for r in x]
    side = np.arange(14) < 7
    moved = chd.relocate_rows(side, rows, 6, 3, 30)
    assert min(moved.sum(), (~moved).sum()) >= 3
    assert brute_chi2(moved, x) >= brute_chi2(side, x) - 1e-9
    assert chd.bipartition_chi2(moved, rows, 6) == pytest.approx(brute_chi2(moved, x))
    for i in range(14):
        other = moved.copy()
        other[i] = not other[i]
        if min(other.sum(), (~other).sum()) >= 3:
            assert brute_chi2(other, x) <= brute_chi2(moved, x) + 1e-6


def test_positions_are_ranks_whatever_the_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"u{i:03d}", float(rng.randint(0, 9))) for i in range(200)]
    monkeypatch.setattr(chd, "RANGE_ROWS", 15)
    got = {r["u"]: r["pos"] for r in chd.positions(spark.createDataFrame(rows, "u string, x double"), "x", "u").collect()}
    assert got == {u: k for k, (u, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), start=1)}


def test_two_blocks_are_found(spark):
    found = chd.classify(blocks(spark), chd.Division(n_classes=2))
    classes = {r["uce_id"]: r["class"] for r in found.assign.collect()}
    assert len({classes[f"u{i:02d}"] for i in range(10)}) == len({classes[f"u{i:02d}"] for i in range(10, 20)}) == 1
    assert len(set(classes.values())) == 2
    assert chd.dendrogram(found.tree).count() == 3


def test_too_few_segments_are_refused(spark):
    with pytest.raises(MatrixError):
        chd.classify(spark.createDataFrame([("a", "x")], "uce_id string, form string"))
    assert issubclass(MatrixError, LexicalError)


def test_adjusted_rand_ignores_names(spark):
    a = spark.createDataFrame([(str(i), i % 3) for i in range(12)], "uce_id string, class int")
    b = a.withColumn("class", (F.col("class") + 1) % 3)
    assert contingency.adjusted_rand(a, b).first()["ari"] == 1.0


# ---- tables, graphs, distances --------------------------------------------------------------


def test_correspondence_analysis_of_a_small_table(spark):
    n = np.array([[10, 2, 3], [4, 9, 1], [5, 5, 12], [1, 0, 7]])
    rows = [(f"f{i}", str(j), int(n[i, j])) for i in range(4) for j in range(3)]
    got = ca.analyse(spark.createDataFrame(rows, "form string, class string, n long"))
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    eigen = np.linalg.svd(s, compute_uv=False)[:2] ** 2
    assert [x["eigenvalue"] for x in got.axes.orderBy("axis").collect()] == pytest.approx(eigen)
    sums = got.points.groupBy("kind", "axis").agg(F.sum("contrib").alias("c")).collect()
    assert [x["c"] for x in sums] == pytest.approx([1.0] * 4)
    assert got.points.groupBy("kind", "label").agg(F.sum("cos2").alias("c")).where("c > 1.000001").isEmpty()


def test_spanning_forest_is_maximal(spark):
    random.seed(4)
    names = [f"n{i}" for i in range(7)]
    edges = [(a, b, float(random.randint(0, 5))) for a, b in itertools.combinations(names, 2)]
    edges += [("z1", "z2", 3.0)]
    tree = graph.spanning_tree(spark.createDataFrame(edges, "form_i string, form_j string, weight double")).collect()
    assert len(tree) == 7  # six edges of one component, one of the other
    best = max(
        (sum(e[2] for e in chosen) for chosen in itertools.combinations([e for e in edges if e[2] > 0 and e[0] != "z1"], 6) if spans(chosen, names)), default=0
    )
    assert sum(r["weight"] for r in tree) == best + 3


def spans(edges, names):
    seen, todo = set(), [names[0]]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b, _ in edges if x in (a, b)]
    return len(seen) == len(names)


def test_communities_part_two_cliques_joined_by_one_edge(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 5.0) for g in "ab" for i, j in itertools.combinations(range(4), 2)] + [("a0", "b0", 1.0)]
    nodes = spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(4)], "form string")
    got = {r["form"]: r["community"] for r in graph.communities(spark.createDataFrame(edges, "form_i string, form_j string, weight double"), nodes).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1
    assert got["a0"] != got["b0"]


def test_average_linkage(spark):
    pairs = [("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 6.0)]
    rows = labbe.average_linkage(spark.createDataFrame(pairs, "group_a string, group_b string, distance double")).orderBy("step").collect()
    assert [r["height"] for r in rows] == [1.0, 5.0]


def test_topics_of_two_vocabularies_are_told_apart(spark):
    rows = [(str(d), f"{'ab'[d % 2]}{w}", 5) for d in range(20) for w in range(5)]
    model, words, vectors = topics.fit(spark.createDataFrame(rows, "doc_id string, form string, n long"), k=2, iterations=30)
    got = {r["doc_id"]: r["topic"] for r in topics.dominant_topics(model, vectors).collect()}
    assert len({got[str(d)] for d in range(0, 20, 2)}) == 1
    assert got["0"] != got["1"]
    assert topics.top_terms(model, words, 5).count() == 10


def test_saturation_needs_a_condition_that_lasts(spark):
    curve = spark.createDataFrame([(1, None), (2, 0.01), (3, 0.2), (4, None), (5, 0.01), (6, 0.02)], "k long, r double")
    assert saturation.first_sustained(curve, F.col("r") < 0.05).first()["k"] == 5


def test_phrases_exclude_stopwords_at_their_ends(spark):
    docs = spark.createDataFrame([(1, "the big cat sat. the big cat ran. a dog slept.")], "doc_id long, text string")
    stop = spark.createDataFrame([("the",), ("a",)], "token string")
    phrases = [r["phrase"] for r in concordance.key_phrases(docs, stop).collect()]
    assert "big cat" in phrases
    assert not any(p.startswith(("the", "a ")) for p in phrases)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    empty = lexicon.keyed_lexicon(spark.createDataFrame([], "form string, lemma string, pos string"))
    active = segment.active_forms(segment.segments(docs), empty)
    assert dtm.dtm(active).count() == 0
    assert dtm.form_stats(active).count() == 0


# ---- files ----------------------------------------------------------------------------------


def test_a_folder_of_many_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Moderador: hm\nAnna: olá [ri] mundo".encode("cp1252"))
    (tmp_path / "b.md").write_text("# Head\n**bold** [label](http://x)")
    (tmp_path / "c.csv").write_text("id;answer;age\nr1;yes indeed;20\nr2;no;30\n")
    (tmp_path / "metadata.csv").write_text("file;town\na.txt;Porto\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in/e.txt", "zipped text")
        z.writestr("../evil.txt", "no")
    docs = {r["uci_id"]: r for r in documents.import_directory(spark, str(tmp_path)).collect()}
    assert set(docs) == {"a", "b", "r1", "r2", "e"}
    assert docs["a"]["text"] == "olá mundo"
    assert docs["a"]["variables"] == {"town": "Porto"}
    assert docs["b"]["text"].split() == ["Head", "bold", "label"]
    assert docs["r1"]["variables"]["age"] == "20"


def test_a_folder_without_documents(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1")
    with pytest.raises(CorpusError):
        documents.import_directory(spark, str(tmp_path))


def test_dictionaries(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("a\tb\tver\na\tc\tnom\nx\t\t\n")
    got = {r["form"]: (r["lemma"], r["pos"]) for r in dictionaries.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()}
    assert got == {"a": ("c", "nom"), "x": ("x", "nom")}
    (tmp_path / "syn.csv").write_text("variante,canonico\nA,b\n")
    assert dictionaries.read_synonyms(spark, str(tmp_path / "syn.csv")) == {"a": "b"}
    (tmp_path / "stop.txt").write_text("The # article\n\n#x\n")
    assert dictionaries.read_stopwords(spark, str(tmp_path / "stop.txt")) == ("the",)
    (tmp_path / "expr.txt").write_text("new york\nred cross\tRC\nsingle\n")
    assert dictionaries.read_user_expressions(spark, str(tmp_path / "expr.txt")) == {"new york": "new_york", "red cross": "RC"}


def test_prepared_tables_come_back(spark, tmp_path):
    prep = Preparation(stopwords=("x",), synonyms={"a": "b"})
    table = spark.createDataFrame([("u", "f")], "uce_id string, form string")
    back = prepared.write_prepared(spark, str(tmp_path / "p"), prep, {"dtm": table})
    assert back.prep == prep
    assert back.dtm.collect() == table.collect()


def test_exports(spark):
    pairs = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a")], "uce_id string, form string")
    assert [tuple(r) for r in export.wide_dtm(pairs).orderBy("uce_id").collect()] == [("u1", 1, 1), ("u2", 1, 0)]
    nodes = spark.createDataFrame([("a", 2, 0), ("b&", 1, 0)], "form string, freq long, community int")
    edges = spark.createDataFrame([("a", "b&", 1.0)], "form_i string, form_j string, weight double")
    assert 'label="b&amp;"' in export.gexf(nodes, edges)
    assert "<h2>pairs</h2>" in export.report({"pairs": pairs, "none": None}, "t")


def test_command_line(spark, tmp_path):
    from lexmill.__main__ import main

    rng = random.Random(3)
    for g in "abc":
        words = [f"{g}{i}" for i in range(12)] + ["common", "shared"]
        (tmp_path / f"{g}.txt").write_text(" ".join(" ".join(rng.choice(words).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)) + "." for _ in range(30)))
    out = str(tmp_path / "out")
    main(["prepare", str(tmp_path), out, "--uce-size", "24"], spark)
    main(["chd", out], spark)
    main(["simi", out, "--top", "10"], spark)
    main(["kwic", out, "--query", "common"], spark)
    assert spark.read.parquet(f"{out}/chd_classes").count() == spark.read.parquet(f"{out}/dtm").select("uce_id").distinct().count()
    assert 0 < spark.read.parquet(f"{out}/kwic").count() <= 40
    main(["report", out], spark)
    assert "characteristic_terms" in spark.read.parquet(f"{out}/report").first()["value"]
