"""Every registered query of the library's own operators beside its SQL, and the contract of the entry point."""

import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

import __spark_entry__
from lexmill.plans import queries as core
from tests.comparing import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, duck, name):
    assert compare(core.queries()[name](spark, SF), duck, core.oracle_sql()[name]) == ""


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert "form" in df.columns
    assert df.count() > 0


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_the_rest_works_without_the_training_data_operators(tmp_path, gone):
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q), q; assert 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=target, env=os.environ | {"PYTHONPATH": str(target)}, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr


def test_clustering_and_topics_take_all_forms_and_the_iterations_of_the_operators(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(core, "_divided", {})

    def fit(counts, *args, **kwargs):
        asked.append((counts, args, kwargs))
        return None, None, None

    def classify(pairs, *args, **kwargs):
        asked.append((pairs, args, kwargs))
        return SimpleNamespace(assign=None, tree=None, terms=None)

    monkeypatch.setattr(core.topics, "fit", fit)
    monkeypatch.setattr(core.topics, "top_terms", lambda *_: None)
    monkeypatch.setattr(core.topics, "dominant_topics", lambda *_: None)
    monkeypatch.setattr(core.chd, "classify", classify)
    for name in ("lda_topics", "lda_documents", "chd_classes", "chd_terms"):
        core.queries()[name](spark, SF)
    active = core.active_forms(spark, SF)
    want = active.groupBy("form").count().where("count >= 3").count()
    for table, args, kwargs in asked:
        assert (args, kwargs) == ((), {})
        assert table.select("form").distinct().count() == want
