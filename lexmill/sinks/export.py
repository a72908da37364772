"""Exports: wide and long tables, starred corpus text, graphs, figures' tables and a report."""

from __future__ import annotations

import html
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.errors import MatrixError
from lexmill.functions.text import normalise_blanks

MAX_WIDE_FORMS = 5000


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated UTF-8 with a header, in as many files as partitions."""
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def wide_dtm(pairs: DataFrame) -> DataFrame:
    """uce_id and one 0/1 column a form, for other programs; refused beyond ``MAX_WIDE_FORMS`` forms."""
    forms = [r["form"] for r in pairs.select("form").distinct().orderBy("form").limit(MAX_WIDE_FORMS + 1).collect()]
    if len(forms) > MAX_WIDE_FORMS:
        raise MatrixError(f"more than {MAX_WIDE_FORMS} forms; export the long table")
    return pairs.groupBy("uce_id").pivot("form", forms).agg(F.lit(1)).na.fill(0)


def starred_text(docs: DataFrame) -> DataFrame:
    """(uci_id, value): each document below a line ``**** *name_value``; blanks in values become ``-``."""
    entries = F.filter(F.map_entries("variables"), lambda e: e["value"].isNotNull() & (F.trim(e["value"]) != ""))
    stars = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("*"), e["key"], F.lit("_"), F.regexp_replace(F.trim(e["value"]), r"\s+", "-")))
    head = F.rtrim(F.concat(F.lit("**** "), F.array_join(stars, " ")))
    return docs.select("uci_id", F.concat(head, F.lit("\n"), F.col("text")).alias("value"))


def segment_meta(segs: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """(uce_id, uci_id, one column a variable); missing values are empty."""
    variables = docs.select("uci_id", *[F.coalesce(F.col("variables")[n], F.lit("")).alias(n) for n in names])
    return segs.select("uce_id", "uci_id").join(variables, "uci_id").select("uce_id", "uci_id", *names)


def segment_texts(segs: DataFrame) -> DataFrame:
    """(uce_id, text) with white space collapsed."""
    return segs.select("uce_id", normalise_blanks(F.col("text")).alias("text"))


def gexf(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> str:
    """The graph as GEXF; ``nodes`` (form, freq, community), ``edges`` (form_i, form_j, weight); refused beyond ``most`` of either."""
    shown = nodes.select("form", "freq", "community").orderBy("form").limit(most + 1).collect()
    links = edges.select("form_i", "form_j", "weight").orderBy("form_i", "form_j").limit(most + 1).collect()
    if max(len(shown), len(links)) > most:
        raise MatrixError(f"more than {most} nodes or edges; export the tables")
    known = {r["form"]: i for i, r in enumerate(shown)}
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="undirected">']
    lines += ['<attributes class="node"><attribute id="0" title="freq" type="long"/><attribute id="1" title="community" type="integer"/></attributes>', "<nodes>"]
    for r in shown:
        lines.append(f'<node id="{known[r["form"]]}" label={quoteattr(r["form"])}><attvalues><attvalue for="0" value="{r["freq"]}"/><attvalue for="1" value="{r["community"]}"/></attvalues></node>')
    lines += ["</nodes>", "<edges>"]
    for i, r in enumerate(links):
        if r["form_i"] in known and r["form_j"] in known:
            lines.append(f'<edge id="{i}" source="{known[r["form_i"]]}" target="{known[r["form_j"]]}" weight="{r["weight"]}"/>')
    return "\n".join([*lines, "</edges>", "</graph>", "</gexf>"])


def histogram(values: DataFrame, column: str, width: Column | int) -> DataFrame:
    """(bin, n): counts of a numeric column by bins of a width, for a figure."""
    w = F.lit(width) if isinstance(width, int) else width
    return values.groupBy((F.floor(F.col(column) / w) * w).alias("bin")).agg(F.count("*").alias("n"))


def report(sections: dict[str, DataFrame | None], title: str, most: int = 50) -> str:
    """One HTML page with a table a section; sections without a table are left out."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        if df is None:
            continue
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*parts, "</body></html>"])
