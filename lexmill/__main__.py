"""Command line: ``python -m lexmill STAGE ...``.

``prepare`` turns a folder of documents into prepared tables; every other stage
reads these and writes tables below the same folder; ``all`` runs the stages one
after another and goes on after one that fails.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Preparation
from lexmill.errors import LexicalError
from lexmill.functions.text import MODERATORS
from lexmill.operators import ca, chd, concordance, contingency, dtm, graph, labbe, lexicon, saturation, segment, sentiment, topics
from lexmill.sinks import export
from lexmill.sources import dictionaries, documents
from lexmill.sources.prepared import Prepared, read_prepared, write_prepared
from lexmill.workers import importable

Arguments = argparse.Namespace


def _lexicon(spark: SparkSession, folder: str | None) -> DataFrame:
    if folder is None:
        return lexicon.keyed_lexicon(spark.createDataFrame([], "form string, lemma string, pos string"))
    return lexicon.keyed_lexicon(dictionaries.read_lexicon(spark, f"{folder}/lexicon.txt"), dictionaries.read_keys(spark, f"{folder}/key.cfg"))


def _lexicon_expressions(spark: SparkSession, folder: str | None) -> dict[str, str]:
    try:
        return dictionaries.read_expressions(spark, f"{folder}/expression.txt") if folder else {}
    except AnalysisException:  # a lexicon needn't have any
        return {}


def prepare(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    drop = () if a.keep_all_speakers else tuple(a.drop_speakers.split(",")) if a.drop_speakers else MODERATORS
    docs = documents.import_directory(spark, a.corpus, a.text_column, drop)
    prep = Preparation(
        stopwords=dictionaries.read_stopwords(spark, a.stopwords) if a.stopwords else (),
        synonyms=dictionaries.read_synonyms(spark, a.synonyms) if a.synonyms else {},
        expressions=dictionaries.read_user_expressions(spark, a.expressions) if a.expressions else {},
        lexicon_expressions=_lexicon_expressions(spark, a.dictionaries),
        adverbs_active=not a.no_adverbs,
        unknown_active=not a.unknown_supplementary,
        min_token_length=a.min_token_len,
        anonymous_prefix=a.anon_prefix or None,
        segment_tokens=a.uce_size,
        min_occurrences=a.min_freq,
    )
    segs = segment.segments(docs, a.uce_size, "uci_id")
    active = segment.active_forms(segs, _lexicon(spark, a.dictionaries), prep)
    pairs = dtm.dtm(active, a.min_freq)
    tables = {"documents": docs, "segments": segs, "active": active, "dtm": pairs, "forms": dtm.retained_forms(active, a.min_freq)}
    p = write_prepared(spark, a.prepared, prep, tables)
    dtm.check_dtm(p.dtm)
    figures = dtm.diagnostics(p.segments, p.active, a.min_freq)
    return {"diagnostics": figures, "advice": dtm.advice(figures), "starred_text": export.starred_text(p.documents), "segment_texts": export.segment_texts(p.segments)}


def _variable(p: Prepared, name: str, alias: str) -> DataFrame:
    values = p.documents.select("uci_id", F.col("variables")[name].alias(alias))
    return p.segments.select("uci_id", "uce_id").join(values, "uci_id").select("uce_id", alias)


def _few(values: DataFrame, most: int) -> list[str]:
    """The distinct values in order; an error beyond so many."""
    rows = values.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise LexicalError(f"more than {most} values of {values.columns[0]}")
    return sorted(r[0] for r in rows)


def _names(p: Prepared, asked: str | None) -> list[str]:
    if asked:
        return asked.split(",")
    return _few(p.documents.select(F.explode(F.map_keys("variables")).alias("k")), 1000)


def run_chd(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p, d = read_prepared(spark, a.prepared), chd.Division(a.n_classes, a.min_class_size, not a.no_relocate)
    found = chd.classify(p.dtm, d)
    out = {
        "chd_classes": found.assign,
        "chd_tree": found.tree.join(chd.dendrogram(found.tree), "node"),
        "characteristic_terms": found.terms,
        "typical_segments": contingency.typical_segments(p.dtm, found.assign, found.terms),
        "chd_warnings": contingency.partition_warnings(found.assign, found.terms, d.n_classes, d.min_class_size),
    }
    if a.stability:
        out["chd_stability"] = chd.stability(p.dtm, found.assign, d)
    return out


def run_afc(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    classes = spark.read.parquet(f"{a.prepared}/chd_classes")
    found = ca.analyse(contingency.form_class_table(p.dtm, classes))
    parts = None
    for name in _names(p, a.variables):
        one = _variable(p, name, "part").select("uce_id", F.lit(name).alias("variable"), "part")
        parts = one if parts is None else parts.unionByName(one)
    out = {"afc_axes": found.axes, "afc_coords": ca.coordinates_table(found)}
    if parts is not None:
        out["specificities"] = contingency.specificities(contingency.part_table(p.dtm, parts))
    return out


def run_simi(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    forms = graph.top_forms(p.dtm, a.top)
    n = p.dtm.agg(F.count_distinct("uce_id")).first()[0]
    tree = graph.spanning_tree(graph.association(graph.cooccurrence(p.dtm, forms), n, a.index))
    nodes = forms.join(graph.communities(tree, forms), "form")
    return {
        "simi_edges": tree,
        "simi_nodes": nodes.join(graph.force_layout(tree, forms), "form"),
        "simi_communities": graph.community_forms(nodes),
        "phi_delta": graph.phi_with_wrong_total(p.dtm, forms),
        "simi_gexf": spark.createDataFrame([(export.gexf(nodes, tree),)], "value string"),
    }


def run_lda(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    counts = dtm.count_matrix(p.active, p.forms, a.level)
    model, words, vectors = topics.fit(counts, a.k, seed=a.seed)
    out = {"lda_topics": topics.top_terms(model, words, a.n_terms), "lda_documents": topics.dominant_topics(model, vectors)}
    if a.stability:
        out["lda_stability"] = topics.stability(counts, a.k)
    if a.ktuning:
        tuned = topics.tune(counts, range(a.k_min, a.k_max + 1))
        out |= {"lda_tuning": tuned, "lda_suggested": topics.combine(tuned), "lda_by_metric": topics.best_by_metric(tuned)}
    return out


def run_labbe(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    pairs = labbe.distances(labbe.group_table(p.dtm, _variable(p, a.by, "group")))
    return {"labbe_distance": labbe.matrix(pairs), "labbe_extremes": labbe.extremes(pairs), "labbe_clusters": labbe.average_linkage(pairs)}


def run_emotions(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    words = spark.read.csv(a.lexicon, header=True, sep=";").select("form", "emotion")
    names = _few(words.select("emotion"), 100)
    each = sentiment.emotions(p.documents, words, names, "uci_id")
    out = {"emotions": each, "emotions_mean": sentiment.mean_emotions(each, names)}
    for v in _names(p, a.variables):
        out[f"emotions_by_{v}"] = sentiment.emotions_by(each, p.documents.select(F.col("uci_id").alias("doc_id"), F.col("variables")[v].alias("value")), names)
    return out


def run_extras(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p, what = read_prepared(spark, a.prepared), a.what.split(",")
    known, out = _lexicon(spark, a.dictionaries), {}
    if "ngrams" in what:
        out[f"ngrams_{a.n}"] = concordance.ngrams(p.active, a.n)
    if "wordtree" in what and a.query:
        out["word_tree"] = concordance.word_tree(p.documents, a.query, known, p.prep, a.direction, a.depth, "uci_id")
    if "wordcloud" in what:
        out["wordcloud"] = p.forms.select("form", "freq")
    if "heatmap" in what:
        out["heatmap"] = contingency.class_proportions(p.dtm, spark.read.parquet(f"{a.prepared}/chd_classes"), a.top)
    if "yake" in what:
        stop = concordance.inactive_surface(segment.segment_tokens(p.segments, p.prep), known, p.prep)
        out["key_phrases"] = concordance.key_phrases(p.documents, stop, top=a.top, id_column="uci_id")
    return out


def run_kwic(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    found = concordance.concordance(p.documents, a.query, _lexicon(spark, a.dictionaries), p.prep, a.window, a.mode, "uci_id")
    return {"kwic": found.orderBy("doc_id", "position").limit(a.max)}


def run_sentiment(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    none = spark.createDataFrame([], "lemma string, polarity int")
    words = sentiment.extend_lexicon(none, dictionaries.read_polarities(spark, a.lexicon))
    rows, key = (p.documents, "uci_id") if a.level == "uci" else (p.segments, "uce_id")
    found = sentiment.score(rows, _lexicon(spark, a.dictionaries), words, tuple(a.negations.split(",")), p.prep, key)
    return {"sentiment": found, "sentiment_labels": sentiment.label_counts(found)}


def run_saturation(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    p = read_prepared(spark, a.prepared)
    groups = _variable(p, a.by, "group")
    order = saturation.valid_groups(groups)
    curve = saturation.saturation(p.dtm, groups, order, None, a.min_freq, chd.Division(a.n_classes), a.topn)
    return {"saturation": curve, "saturation_points": saturation.breakdown(curve), "saturation_random": saturation.random_orders(p.dtm, groups, a.runs, a.min_freq, a.seed)}


def run_report(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    sections = {}
    for name in ("diagnostics", "advice", "characteristic_terms", "typical_segments", "afc_axes", "specificities", "simi_communities", "lda_topics", "labbe_extremes", "saturation_points"):
        try:
            sections[name] = spark.read.parquet(f"{a.prepared}/{name}")
        except Exception:  # the section's stage hasn't run  # noqa: BLE001
            sections[name] = None
    return {"report": spark.createDataFrame([(export.report(sections, "Lexical report"),)], "value string")}


def run_all(spark: SparkSession, a: Arguments) -> dict[str, DataFrame]:
    for name in ("chd", "afc", "simi", "lda", "labbe", "extras", "saturation", "report"):
        try:
            main([name, a.prepared], spark)
        except Exception as error:  # the other stages may still run  # noqa: BLE001
            print(f"{name}: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
    return {}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("lexmill")
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, run: Callable[[SparkSession, Arguments], dict[str, DataFrame]], **options: object) -> None:
        sub = stages.add_parser(name)
        if name == "prepare":
            sub.add_argument("corpus")
        sub.add_argument("prepared")
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, default=default, type=type(default) if isinstance(default, int) else str)
        sub.set_defaults(run=run)

    stage(
        "prepare", prepare, uce_size=40, min_freq=3, dictionaries=None, text_column=None, stopwords=None, synonyms=None, expressions=None, no_adverbs=False,
        unknown_supplementary=False, min_token_len=1, anon_prefix="anon", drop_speakers=None, keep_all_speakers=False,
    )
    stage("chd", run_chd, n_classes=3, min_class_size=5, no_relocate=False, stability=False)
    stage("afc", run_afc, variables=None)
    stage("simi", run_simi, index="cooccurrence", top=60)
    stage("lda", run_lda, k=3, level="uci", n_terms=10, seed=0, stability=False, ktuning=False, k_min=2, k_max=10)
    stage("labbe", run_labbe, by="source")
    stage("emotions", run_emotions, lexicon=None, variables=None)
    stage("extras", run_extras, what="ngrams,wordcloud,heatmap,yake", n=2, query=None, direction="right", depth=2, top=30, dictionaries=None)
    stage("kwic", run_kwic, query="", mode="lemma", window=6, max=40, dictionaries=None)
    stage("sentiment", run_sentiment, level="uci", lexicon=None, negations="no,not,never", dictionaries=None)
    stage("saturation", run_saturation, by="source", n_classes=4, min_freq=3, runs=10, topn=20, seed=0)
    stage("report", run_report)
    stage("all", run_all)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one stage; its tables are written as Parquet and, where columns allow, as CSV."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexmill").getOrCreate()
    importable(spark)
    for name, df in a.run(spark, a).items():
        df.write.mode("overwrite").parquet(f"{a.prepared}/{name}")
        if all(kind in ("string", "int", "bigint", "double", "boolean") for _, kind in df.dtypes):
            export.write_csv(spark.read.parquet(f"{a.prepared}/{name}"), f"{a.prepared}/csv/{name}")


if __name__ == "__main__":
    main()
