"""Similarity graph of forms: co-occurrence, association, spanning tree, communities, layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.errors import MatrixError
from lexmill.operators.chunks import Chunk, each

INDICES = ("cooccurrence", "jaccard", "dice", "cosine", "phi")
MAX_DRIVER_FORMS = 3000


def top_forms(pairs: DataFrame, top: int = 60) -> DataFrame:
    """(form, freq): the forms in most segments; ties in the order of the alphabet."""
    return pairs.groupBy("form").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "form").limit(top)


def cooccurrence(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(form_i, form_j, a, f_i, f_j) for i before j, of forms that share a segment.

    The forms of a segment are gathered in one shuffle and paired inside the row.
    """
    kept = pairs.join(F.broadcast(forms.select("form")), "form", "left_semi")
    rows = kept.groupBy("uce_id").agg(F.sort_array(F.collect_list("form")).alias("fs")).where("size(fs) > 1")
    later = F.flatten(F.transform("fs", lambda x, i: F.transform(F.slice("fs", i + 2, F.size("fs")), lambda y: F.struct(x.alias("form_i"), y.alias("form_j")))))
    counts = rows.select(F.explode(later).alias("p")).groupBy("p.form_i", "p.form_j").agg(F.count("*").alias("a"))
    return _with_sizes(counts, forms)


def _with_sizes(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """``counts`` (form_i, form_j, a) with the segments of either form."""
    size = forms.select("form", "freq")
    return counts.join(F.broadcast(size.withColumnsRenamed({"form": "form_i", "freq": "f_i"})), "form_i").join(
        F.broadcast(size.withColumnsRenamed({"form": "form_j", "freq": "f_j"})), "form_j"
    ).select("form_i", "form_j", "a", "f_i", "f_j")


def cooccurrence_of_chunks(table: DataFrame, forms: DataFrame) -> DataFrame:
    """The same from a term table in chunks; ``forms`` are few and go to every task, a chunk gives one row a pair."""
    names = [r["form"] for r in forms.select("form").collect()]
    if len(names) > MAX_DRIVER_FORMS:
        raise MatrixError(f"{len(names)} forms; take {MAX_DRIVER_FORMS} at most")
    names = pa.array(sorted(names, key=lambda x: x.encode()), pa.string())

    def count(chunk: Chunk) -> pa.Table | None:
        place = pc.fill_null(pc.index_in(chunk.forms, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = place[chunk.codes] if len(chunk.codes) else chunk.codes
        held = code >= 0
        row, code = chunk.rows[held], code[held]
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        met: dict[int, int] = {}
        # the pairs whose places in their segment are so far apart; none further than the longest segment
        for gap in range(1, len(names)):
            same = np.flatnonzero(row[gap:] == row[:-gap])
            if not len(same):
                break
            keys, n = np.unique(code[same] * len(names) + code[same + gap], return_counts=True)
            for key, k in zip(keys.tolist(), n.tolist(), strict=True):
                met[key] = met.get(key, 0) + k
        if not met:
            return None
        keys = np.fromiter(met, np.int64, len(met))
        return pa.table({"form_i": names.take(pa.array(keys // len(names))), "form_j": names.take(pa.array(keys % len(names))), "a": pa.array(met.values(), pa.int64())})

    counts = each(table, count, "form_i string, form_j string, a long").groupBy("form_i", "form_j").agg(F.sum("a").alias("a"))
    return _with_sizes(counts, forms)


def association(cooc: DataFrame, n_segments: int, index: str = "cooccurrence") -> DataFrame:
    """``cooc`` with ``weight`` by one of the indices; undefined values are 0."""
    a, fi, fj = (F.col(c).cast("double") for c in ("a", "f_i", "f_j"))
    b, c = fi - a, fj - a
    d = F.lit(float(n_segments)) - a - b - c
    weight = {
        "cooccurrence": a,
        "jaccard": F.try_divide(a, fi + fj - a),
        "dice": F.try_divide(2 * a, fi + fj),
        "cosine": F.try_divide(a, F.sqrt(fi * fj)),
        "phi": F.try_divide(a * d - b * c, F.sqrt(F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0)))),
    }[index]
    return cooc.withColumn("weight", F.coalesce(weight, F.lit(0.0)))


def phi_with_wrong_total(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(max_abs_diff, mean_abs_diff, n_negative_d): what phi becomes if d counts forms instead of segments.

    Over all pairs of the forms, also those that never meet.
    """
    n = pairs.select("uce_id").distinct().agg(F.count("*").cast("double").alias("n"))
    return phi_gap(cooccurrence(pairs, forms), forms, n)


def phi_gap(cooc: DataFrame, forms: DataFrame, n: DataFrame) -> DataFrame:
    """The same from the co-occurrences and the number of segments (n)."""
    v = forms.agg(F.count("*").cast("double").alias("v"))
    left = forms.select(F.col("form").alias("form_i"), F.col("freq").alias("f_i"))
    right = forms.select(F.col("form").alias("form_j"), F.col("freq").alias("f_j"))
    grid = left.join(right, F.col("form_i") < F.col("form_j"))
    met = cooc.select("form_i", "form_j", "a")
    rows = grid.join(met, ["form_i", "form_j"], "left").crossJoin(n).crossJoin(v).withColumn("a", F.coalesce("a", F.lit(0)).cast("double"))
    b, c = F.col("f_i") - F.col("a"), F.col("f_j") - F.col("a")

    def phi(total: F.Column) -> F.Column:
        d = total - F.col("a") - b - c
        under = (F.col("a") + b) * (c + d) * (F.col("a") + c) * (b + d)
        return F.when(under > 0, (F.col("a") * d - b * c) / F.sqrt(under)).otherwise(0.0)

    gap = F.abs(phi(F.col("n")) - phi(F.col("v")))
    return rows.agg(
        F.round(F.max(gap), 4).alias("max_abs_diff"),
        F.round(F.avg(gap), 4).alias("mean_abs_diff"),
        F.count_if(F.col("v") - F.col("a") - b - c < 0).alias("n_negative_d"),
    )


def _collect_edges(edges: DataFrame) -> list[tuple[str, str, float]]:
    """The edges of a graph of at most ``MAX_DRIVER_FORMS`` forms; a larger one is refused."""
    most = MAX_DRIVER_FORMS * (MAX_DRIVER_FORMS - 1) // 2
    rows = edges.where("weight > 0").select("form_i", "form_j", F.col("weight").cast("double").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise MatrixError(f"the graph has more than {most} edges; take fewer forms")
    return sorted(((r["form_i"], r["form_j"], r["weight"]) for r in rows), key=lambda e: (-e[2], e[0], e[1]))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(form_i, form_j, weight): the maximum spanning forest of the positive edges (form_i, form_j, weight).

    Ties go to the pair first in the alphabet.  The graph is that of the top
    forms, so its edges are bounded and are sorted and joined on the driver.
    """
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j, weight in _collect_edges(edges):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((i, j, weight))
    return edges.sparkSession.createDataFrame(out, "form_i string, form_j string, weight double")


def communities(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(form, community) by greedy modularity moves (Louvain) on the tree; isolated forms are their own."""
    edges = _collect_edges(tree)
    names = sorted(r["form"] for r in nodes.select("form").collect())
    graph: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    place = {x: i for i, x in enumerate(names)}
    for i, j, w in edges:
        graph[place[i]][place[j]] = graph[place[j]][place[i]] = w
    member = {i: i for i in graph}
    total = sum(w for _, _, w in edges)
    level = graph
    while total > 0:
        label = {i: i for i in level}
        degree = {i: sum(x.values()) + x.get(i, 0.0) for i, x in level.items()}
        weight = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in sorted(level):
                here = label[i]
                links: dict[int, float] = {here: 0.0}
                for j, w in level[i].items():
                    if j != i:
                        links[label[j]] = links.get(label[j], 0.0) + w
                weight[here] -= degree[i]
                gain = lambda c: links[c] - weight[c] * degree[i] / (2 * total)  # noqa: B023, E731
                best = max(sorted(links), key=lambda c: (round(gain(c), 12), c == here))  # noqa: B023
                weight[best] += degree[i]
                if best != here:
                    label[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        names_of = {c: k for k, c in enumerate(sorted(set(label.values())))}
        merged: dict[int, dict[int, float]] = {k: {} for k in names_of.values()}
        for i, x in level.items():
            for j, w in x.items():
                if j < i:
                    continue
                a, b = names_of[label[i]], names_of[label[j]]
                merged[a][b] = merged[a].get(b, 0.0) + w
                if a != b:
                    merged[b][a] = merged[b].get(a, 0.0) + w
        member = {i: names_of[label[c]] for i, c in member.items()}
        level = merged
    size = {}
    for c in member.values():
        size[c] = size.get(c, 0) + 1
    rank = {c: k for k, c in enumerate(sorted(size, key=lambda c: (-size[c], c)))}
    return tree.sparkSession.createDataFrame([(names[i], rank[c]) for i, c in member.items()], "form string, community int")


def community_forms(nodes: DataFrame, top: int = 8) -> DataFrame:
    """(community, rank, form, freq): the most frequent forms of each community."""
    order = Window.partitionBy("community").orderBy(F.desc("freq"), "form")
    return nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("community", "rank", "form", "freq")


def edge_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(jaccard, weight_a, weight_b) of two edge sets; the direction of an edge doesn't count."""
    both = lambda e: e.select(F.least("form_i", "form_j").alias("x"), F.greatest("form_i", "form_j").alias("y")).distinct()
    shared = both(a).intersect(both(b)).agg(F.count("*").alias("s"))
    either = both(a).union(both(b)).distinct().agg(F.count("*").alias("u"))
    wa, wb = a.agg(F.sum("weight").alias("weight_a")), b.agg(F.sum("weight").alias("weight_b"))
    return shared.crossJoin(either).crossJoin(wa).crossJoin(wb).select(F.round(F.try_divide("s", "u"), 4).alias("jaccard"), "weight_a", "weight_b")


def force_layout(tree: DataFrame, nodes: DataFrame, iterations: int = 500, seed: int = 42) -> DataFrame:
    """(form, x, y): force-directed layout with degree-scaled repulsion, for graphs of the top forms."""
    names = sorted(r["form"] for r in nodes.select("form").collect())
    place = {x: i for i, x in enumerate(names)}
    edges = _collect_edges(tree)
    n = len(names)
    xy = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    i = np.array([place[e[0]] for e in edges], dtype=int)
    j = np.array([place[e[1]] for e in edges], dtype=int)
    degree = np.bincount(np.concatenate([i, j]), minlength=n) + 1.0
    step = 0.1
    for k in range(iterations):
        gap = xy[:, None, :] - xy[None, :, :]
        squared = (gap**2).sum(axis=2) + 1e-9
        force = (gap * (degree[:, None] * degree[None, :] / squared)[:, :, None]).sum(axis=1) * 0.01
        pull = xy[i] - xy[j]
        np.add.at(force, i, -pull)
        np.add.at(force, j, pull)
        force -= 0.05 * degree[:, None] * xy
        length = np.sqrt((force**2).sum(axis=1, keepdims=True)) + 1e-9
        xy += force / length * np.minimum(length, step * (1 - k / iterations) + 1e-4)
    return tree.sparkSession.createDataFrame([(names[m], float(xy[m, 0]), float(xy[m, 1])) for m in range(n)], "form string, x double, y double")
