import dataclasses
import random
import re

import pytest

from lexmill.llm import line_winnow
from tests.llm.fixtures import SCHEMA, corpus, prose, sentence


def test_long_repeats_go_and_the_first_stays(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    short = sentence(rng, 10)
    rows = []
    for i in range(20):
        own = prose(rng, 8).split(". ")
        middle = passage if i % 4 == 0 else short
        rows.append((i, ". ".join(own[:4]) + ". " + middle + " " + ". ".join(own[4:])))
    got = {r["doc_id"]: r for r in line_winnow.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        if i == 0 or i % 4:
            assert got[i]["text"] == text
            assert got[i]["removed"] == []
        else:
            assert passage not in got[i]["text"]
            assert got[i]["text"] == text.replace(passage + " ", "")
            assert sum(b - a for a, b in ranges(got[i])) == 60


def ranges(row):
    return list(zip(row["removed"][::2], row["removed"][1::2], strict=True))


def brute_force(rows, w):
    """(text, removed) by row: every run of min_words words that came before goes."""
    seen, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        text = rows[k][1]
        words = [m.span() for m in re.finditer(r"[^\t\n\v\f\r ]+", text or "")]
        cover = [False] * len(words)
        for i in range(len(words) - w.min_words + 1):
            run = tuple(text[a:b] for a, b in words[i : i + w.min_words])
            if run in seen:
                cover[i : i + w.min_words] = [True] * w.min_words
            seen.add(run)
        kept, gone, i = text[: words[0][0]] if words else text, [], 0
        for i, c in enumerate(cover):
            stop = words[i + 1][0] if i + 1 < len(words) else len(text)
            if not c:
                kept += text[words[i][0] : stop]
            elif i and cover[i - 1]:
                gone[-1] = i + 1
            else:
                gone += [i, i + 1]
        out.append((rows[k][0], kept, len(words), gone))
    return out


@pytest.mark.parametrize("chunk_bytes", [3000, 6 << 20])
@pytest.mark.parametrize("w", [line_winnow.Winnowing(), line_winnow.Winnowing(gram_words=3, min_words=8), line_winnow.Winnowing(gram_words=8, min_words=8)])
def test_rows_are_those_of_brute_force(spark, w, chunk_bytes):
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, 80)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 20))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in words)))
    rows += [(200, "again " * 500), (201, "ça va " * 40), (202, " \n"), (203, None), (204, "ça va " * 40)]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(3)
    got = line_winnow.dedup_lines(spark, docs, dataclasses.replace(w, chunk_bytes=chunk_bytes)).collect()
    assert sorted((tuple(r) for r in got)) == sorted(brute_force(rows, w))


def test_every_document_of_the_table_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = line_winnow.dedup_lines(spark, docs).collect()
    assert any(r["removed"] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(brute_force(rows, line_winnow.Winnowing()), key=repr)


def test_ids_that_are_not_integers(spark):
    rng = random.Random(2)
    passage = prose(rng, 6)
    docs = spark.createDataFrame([(x, passage) for x in "abcd"] + [(None, passage)], "doc_id string, text string")
    got = {r["doc_id"]: r["text"] for r in line_winnow.dedup_lines(spark, docs).collect()}
    assert sorted(got.values()) == ["", "", "", "", passage]
    assert got[None] == ""


def test_awkward_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", uid int")
    got = line_winnow.dedup_lines(spark, docs).collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got if r["doc_id"] not in (None, 3)}
    assert texts[34] is None
    assert texts[35] == ""
    assert texts[40] == "x" * 200_000
    assert texts[30] == texts[31] == ""
    assert texts[0] == rows[0][1]
    assert line_winnow.dedup_lines(spark, docs.limit(0)).count() == 0


def test_a_run_repeated_inside_one_document(spark):
    rng = random.Random(1)
    passage, other = prose(rng, 6), prose(rng, 6)
    text = f"{passage}\n{other}\n{passage}"
    got = line_winnow.dedup_lines(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["text"] == f"{passage}\n{other}\n"


def test_repeats_that_dont_keep_to_lines_go_to_the_last_word(spark):
    rng = random.Random(5)
    own = [[f"{'abcd'[i]}{rng.randrange(10**9)}" for _ in range(80)] for i in range(4)]
    plain = [f"p{rng.randrange(10**9)}" for _ in range(60)]
    lined = [x + ("." if i % 17 == 9 else "") for i, x in enumerate(plain)]
    rows = []
    for i, passage in enumerate((plain, plain, lined, lined[3:56])):
        rows.append((i, " ".join([*own[i][:40], *passage, *own[i][40:]])))
    got = {r["doc_id"]: r for r in line_winnow.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["removed"] == got[2]["removed"] == []
    assert got[1]["text"] == " ".join(own[1])
    assert got[3]["text"] == " ".join(own[3])
    assert got[3]["removed"] == [40, 93]
