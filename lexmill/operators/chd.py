"""Descending hierarchical classification of segments.

Each split orders the segments of a class by the first axis of its correspondence
analysis, takes the cut of the order with the greatest chi-square between the two
sides' profiles, and relocates segments while that raises it.

The axis comes from Lanczos steps on the sparse cells in one task while they are
few enough, else from block iteration by joins; the chi-square of every cut comes from window
sums: with L_v the count of form v so far, s the cells so far, n all cells and
Q = sum over v of L_v**2 / column_v,

    chi2 = n**2 / (s * (n - s)) * (Q - s**2 / n),

and a segment that holds v for the m-th time adds (2 m - 1) / column_v to Q.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.errors import MatrixError
from lexmill.operators.chunks import Chunk, cells_of, each_with, local_forms
from lexmill.operators.contingency import adjusted_rand, characteristic_cells, characteristic_terms
from lexmill.workers import checkpointing

#: Cells of the largest class whose axis is computed in one task: 16 bytes each there.
MAX_LOCAL_CELLS = 20_000_000
#: Cells of which one task makes the whole classification, at some 40 bytes each, and of a block on the way there.
MAX_TASK_CELLS, BLOCK_CELLS = 60_000_000, 4_000_000
TOLERANCE, LANCZOS_STEPS, MAX_RESTARTS, BLOCK, MAX_STEPS = 1e-9, 120, 100, 8, 500
#: Rows of one task that ranks or sums in order, and the most such tasks.
RANGE_ROWS, MAX_RANGES = 1_000_000, 256


@dataclass(frozen=True)
class Division:
    """How far and how finely to divide; ``relocate`` is sequential and runs in one task a split."""

    n_classes: int = 3
    min_class_size: int = 5
    relocate: bool = True
    max_passes: int = 30
    min_column: int = 2


def filter_columns(cells: DataFrame, least: int = 2) -> DataFrame:
    """The cells of forms in at least ``least`` segments; all cells if no form is."""
    counted = cells.withColumn("k", F.count("*").over(Window.partitionBy("form")))
    kept = counted.where(F.col("k") >= least).drop("k")
    return cells if kept.isEmpty() else kept


def first_axis(cells: DataFrame) -> DataFrame:
    """(uce_id, axis): the segments' coordinates on the first axis, up to scale.

    For 0/1 cells the coordinate is the mean of e_v / sqrt(c_v) over the
    segment's forms, e the leading eigenvector of the forms' residual
    cross-products.  The largest component of e is made positive.  Both ways to
    e, in one task or by joins, end when its residual is below ``TOLERANCE``.
    """
    total = cells.count()
    if not total:
        raise MatrixError("no cell to analyse")
    weights = _local_weights(cells) if total <= MAX_LOCAL_CELLS else _joined_weights(cells, total)
    return cells.join(weights, "form").groupBy("uce_id").agg(F.avg("w").alias("axis"))


def leading_vector(row: np.ndarray, form: np.ndarray, n_rows: int, n_forms: int, tolerance: float) -> np.ndarray:
    """The leading eigenvector of the residual cross-products of 0/1 cells, by restarted Lanczos steps."""
    column = np.bincount(form, minlength=n_forms).astype(np.float64)
    size = np.bincount(row, minlength=n_rows).astype(np.float64)
    scale, root = 1.0 / np.sqrt(column), np.sqrt(column / len(row))

    def apply(e: np.ndarray) -> np.ndarray:
        y = np.bincount(row, weights=(e * scale)[form], minlength=n_rows) / size
        return np.bincount(form, weights=y[row], minlength=n_forms) * scale - root * (root @ e)

    e = np.random.default_rng(0).standard_normal(n_forms)
    e -= root * (root @ e)
    most = min(n_forms, LANCZOS_STEPS)
    for _ in range(MAX_RESTARTS):
        norm = np.linalg.norm(e)
        if norm < 1e-300:
            return root
        basis, alpha, beta = [e / norm], [], []
        while True:
            z = apply(basis[-1])
            alpha.append(float(z @ basis[-1]))
            held = np.array(basis)
            for _ in range(2):
                z -= held.T @ (held @ z)
            left = float(np.linalg.norm(z))
            if left < 1e-13 or len(basis) == most:
                break
            beta.append(left)
            basis.append(z / left)
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        e = held.T @ vectors[:, -1]
        if left * abs(vectors[-1, -1]) <= tolerance * max(1e-3, abs(values[-1])):
            return e / np.linalg.norm(e)
    raise MatrixError("the first axis didn't converge")


def _local_weights(cells: DataFrame) -> DataFrame:
    """(form, w) of at most ``MAX_LOCAL_CELLS`` cells, in one task."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.column("uce_id").combine_chunks().dictionary_encode()
        names, codes = np.unique(table.column("form").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        order = np.lexsort((codes, rows.indices.to_numpy()))
        e = leading_vector(rows.indices.to_numpy()[order], codes[order], len(rows.dictionary), len(names), TOLERANCE)
        if e[np.argmax(np.round(np.abs(e), 9))] < 0:
            e = -e
        c = np.bincount(codes, minlength=len(names)) / len(codes)
        return pa.table({"form": pa.array(names.tolist(), pa.string()), "w": e / np.sqrt(c)})

    placed = cells.select(F.lit(1).alias("task"), F.col("uce_id").cast("string").alias("uce_id"), "form").orderBy("uce_id", "form")
    return placed.groupBy("task").applyInArrow(run, "form string, w double")


def _joined_weights(cells: DataFrame, total: int) -> DataFrame:
    """(form, w) by iteration of ``BLOCK`` vectors at once: two sparse products by joins a step.

    What comes to the driver are cross-products of the block.  The vectors are
    made orthonormal and turned to their Ritz vectors; it ends when the first
    one's residual is small, so close eigenvalues cost steps and not accuracy.
    """
    checkpointing(cells.sparkSession)
    root = F.sqrt("c")
    es = [f"e{k}" for k in range(BLOCK)]
    zs = [f"z{k}" for k in range(BLOCK)]
    start = [((F.pmod(F.xxhash64("form", F.lit(k)), F.lit(2_000_003)) - 1_000_001) / F.lit(1e6)).alias(x) for k, x in enumerate(es)]
    current = cells.groupBy("form").agg((F.count("*") / F.lit(float(total))).alias("c")).select("form", "c", *start).checkpoint()
    for _ in range(MAX_STEPS):
        means = cells.join(current, "form").groupBy("uce_id").agg(*[F.avg(F.col(x) / root).alias(x) for x in es])
        sums = cells.join(means, "uce_id").groupBy("form").agg(*[F.sum(x).alias(z) for x, z in zip(es, zs, strict=True)])
        both = current.join(sums, "form").select("form", "c", *es, *[(F.col(z) / F.lit(float(total)) / root).alias(z) for z in zs]).checkpoint()
        dots = both.agg(*[F.sum(F.col(x) * root) for x in es], *[F.sum(F.col(x) * F.col(y)) for x in es for y in [*es, *zs]], *[F.sum(F.col(z) * root) for z in zs], *[F.sum(F.col(x) * F.col(y)) for x in zs for y in zs]).first()
        values, b = np.array(dots, dtype=float), BLOCK
        er, cross = values[:b], values[b : b + 2 * b * b].reshape(b, 2 * b)
        zr, zz = values[b + 2 * b * b : 2 * b + 2 * b * b], values[2 * b + 2 * b * b :].reshape(b, b)
        # all without the trivial axis, root: E' = E - root er, Z' = A E - root zr
        ee, ez, zz = cross[:, :b] - np.outer(er, er), cross[:, b:] - np.outer(er, zr), zz - np.outer(zr, zr)
        kept, turn = np.linalg.eigh(ee)
        good = kept > 1e-12 * kept[-1]
        half = turn[:, good] / np.sqrt(kept[good])
        ritz, inner = np.linalg.eigh(half.T @ (ez + ez.T) / 2 @ half)
        mix = half @ inner[:, ::-1]
        lead = mix[:, 0]
        residual = float(np.sqrt(max(0.0, lead @ zz @ lead - ritz[-1] ** 2)))
        turned = lambda k, source, off: sum((F.col(x) * F.lit(float(v)) for x, v in zip(source, mix[:, k], strict=True)), F.lit(0.0)) - root * F.lit(float(off @ mix[:, k]))  # noqa: B023, E731
        if residual <= TOLERANCE * max(1e-3, abs(ritz[-1])):
            found = both.select("form", "c", turned(0, es, er).alias("e"))
            sign = found.orderBy(F.desc(F.round(F.abs("e"), 9)), "form").first()["e"]
            return found.select("form", (F.col("e") * F.lit(-1.0 if sign < 0 else 1.0) / root).alias("w"))
        scale = [1.0 / max(1e-12, abs(r)) for r in ritz[::-1]] + [1.0] * (b - len(ritz))
        turns = [(turned(k, zs, zr) * F.lit(scale[k])).alias(es[k]) if k < mix.shape[1] else start[k] for k in range(b)]
        current = both.select("form", "c", *turns)
    raise MatrixError("the first axis didn't converge")


def positions(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """``rows`` with ``pos``, from 1 in the order of a numeric key and then of the tie.

    Ranges of the key are ranked apart, each in a task, and shifted by the sizes
    of those before; approximate quantiles only balance the ranges, so the
    result doesn't depend on their accuracy.
    """
    n = rows.count()
    ranges = min(MAX_RANGES, -(-n // RANGE_ROWS))
    if ranges <= 1:
        return rows.withColumn("pos", F.row_number().over(Window.orderBy(key, tie)).cast("long"))
    edges = sorted(set(rows.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.001)))
    placed = rows.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: x < F.col(key))))
    before = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy(key, tie))
    ranked = placed.withColumn("inner", inner).join(F.broadcast(before), "range")
    return ranked.withColumn("pos", (F.col("inner") + F.col("shift")).cast("long")).drop("range", "inner", "shift")


def order_rows(units: DataFrame, axis: DataFrame) -> DataFrame:
    """(uce_id, pos): segments by axis, then by name; those without a form are at 0."""
    placed = units.select("uce_id").join(axis, "uce_id", "left").withColumn("axis", F.round(F.coalesce("axis", F.lit(0.0)), 9))
    return positions(placed, "axis", "uce_id").select("uce_id", "pos")


def cut_scores(ordered: DataFrame, cells: DataFrame) -> DataFrame:
    """(pos, chi2): chi-square of cutting after each position but the last.

    ``ordered`` has (uce_id, pos), ``cells`` (uce_id, form).  Running sums are
    taken within ranges of positions and shifted by the sums of those before.
    """
    placed = cells.join(ordered.select("uce_id", "pos"), "uce_id")
    met = placed.withColumn("m", F.row_number().over(Window.partitionBy("form").orderBy("pos"))).withColumn(
        "col", F.count("*").over(Window.partitionBy("form"))
    )
    steps = met.groupBy("pos").agg(F.sum((2 * F.col("m") - 1) / F.col("col")).alias("dq"), F.count("*").alias("ds"))
    rows = ordered.select("pos").join(steps, "pos", "left").na.fill(0, ["dq", "ds"])
    rows = rows.withColumn("range", F.floor((F.col("pos") - 1) / F.lit(RANGE_ROWS)))
    sums = rows.groupBy("range").agg(F.sum("dq").alias("q0"), F.sum("ds").alias("s0"), F.max("pos").alias("p0"))
    before, whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shifts = sums.select(
        "range",
        F.coalesce(F.sum("q0").over(before), F.lit(0.0)).alias("q1"),
        F.coalesce(F.sum("s0").over(before), F.lit(0)).alias("s1"),
        F.sum("s0").over(whole).cast("double").alias("n"),
        F.max("p0").over(whole).alias("last"),
    )
    upto = Window.partitionBy("range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("q2", F.sum("dq").over(upto)).withColumn("s2", F.sum("ds").over(upto)).join(F.broadcast(shifts), "range")
    run = run.withColumn("q", F.col("q1") + F.col("q2")).withColumn("s", (F.col("s1") + F.col("s2")).cast("double")).where("pos < last")
    return _cut_chi2(run)


def _cut_chi2(run: DataFrame) -> DataFrame:
    """(pos, chi2) from the running sums (pos, q, s) and the number of cells (n)."""
    inside = (F.col("s") > 0) & (F.col("s") < F.col("n"))
    chi2 = F.when(inside, F.col("n") * F.col("n") / (F.col("s") * (F.col("n") - F.col("s"))) * (F.col("q") - F.col("s") * F.col("s") / F.col("n")))
    return run.select("pos", F.coalesce(chi2, F.lit(0.0)).alias("chi2"))


def cut_scores_of_chunks(table: DataFrame, min_occurrences: int) -> DataFrame:
    """The same from a term table in chunks whose segments are in order, of the forms that occur often enough.

    A form's cells are counted by chunk, so what precedes a chunk is a sum over
    the lists of chunks; no cell is moved.
    """
    by_form = Window.partitionBy("form")
    earlier = by_form.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = local_forms(table).select(
        "chunk", "code", F.sum("freq").over(by_form).alias("freq"), F.sum("n_uce").over(by_form).alias("col"), F.coalesce(F.sum("n_uce").over(earlier), F.lit(0)).alias("before")
    )

    def sums(chunk: Chunk, known: pa.Table) -> pa.Table:
        column, before = np.zeros(len(chunk.forms)), np.zeros(len(chunk.forms))
        at = known.column("code").to_numpy()
        column[at], before[at] = known.column("col").to_numpy(), known.column("before").to_numpy()
        kept = column[chunk.codes] > 0
        code, row = chunk.codes[kept], chunk.rows[kept]
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code, minlength=len(column))
        rank = np.empty(len(code))
        rank[order] = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        dq = np.bincount(row, weights=(2 * (before[code] + rank) + 1) / column[code], minlength=len(chunk.sizes))
        ds = np.bincount(row, minlength=len(chunk.sizes))
        n = len(chunk.sizes)
        return pa.table({"chunk": np.full(n, chunk.number), "i": np.arange(1, n + 1), "q2": np.cumsum(dq), "s2": np.cumsum(ds).astype(np.int64)})

    rows = each_with(table, known.where(F.col("freq") >= min_occurrences).select("chunk", "code", "col", "before"), sums, "chunk long, i long, q2 double, s2 long").persist()
    ends = rows.groupBy("chunk").agg(F.max("i").alias("k"), F.max_by("q2", "i").alias("q0"), F.max("s2").alias("s0"))
    before, whole = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shifts = ends.select(
        "chunk",
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k1"),
        F.coalesce(F.sum("q0").over(before), F.lit(0.0)).alias("q1"),
        F.coalesce(F.sum("s0").over(before), F.lit(0)).alias("s1"),
        F.sum("s0").over(whole).cast("double").alias("n"),
        F.sum("k").over(whole).alias("last"),
    )
    run = rows.join(F.broadcast(shifts), "chunk").select(
        (F.col("k1") + F.col("i")).alias("pos"), (F.col("q1") + F.col("q2")).alias("q"), (F.col("s1") + F.col("s2")).cast("double").alias("s"), "n", "last"
    )
    return _cut_chi2(run.where("pos < last"))


def best_cut(ordered: DataFrame, cells: DataFrame, min_size: int = 1) -> tuple[int, float]:
    """(position, chi2) of the first best cut with both sides large enough; any cut if none is."""
    n = ordered.count()
    scores = cut_scores(ordered, cells)
    allowed = scores.where((F.col("pos") >= min_size) & (F.col("pos") <= n - min_size))
    order = [F.desc(F.round("chi2", 9)), "pos"]
    row = allowed.orderBy(*order).first() or scores.orderBy(*order).first()
    return (row["pos"], row["chi2"]) if row else (0, 0.0)


def bipartition_chi2(side: np.ndarray, rows: list[np.ndarray], n_forms: int) -> float:
    """Chi-square of the two sides' form counts (0/1 rows as lists of forms)."""
    left, right = np.zeros(n_forms), np.zeros(n_forms)
    for s, fs in zip(side, rows, strict=True):
        (left if s else right)[fs] += 1
    col, s, n = left + right, left.sum(), left.sum() + right.sum()
    if s == 0 or s == n:
        return 0.0
    used = col > 0
    return float(n * n / (s * (n - s)) * ((left[used] ** 2 / col[used]).sum() - s * s / n))


def relocate_rows(side: np.ndarray, rows: list[np.ndarray], n_forms: int, min_size: int, passes: int) -> np.ndarray:
    """Move rows, in their order, to the other side while that raises chi-square; each move counts at once."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    codes = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows]) if len(rows) else np.zeros(0, dtype=np.int64)
    return relocate_cells(side, sizes, codes, n_forms, min_size, passes)


def relocate_cells(side: np.ndarray, sizes: np.ndarray, codes: np.ndarray, n_forms: int, min_size: int, passes: int) -> np.ndarray:
    """The same of rows that lie one after the other in ``codes``.

    A block of rows is tried at once.  Up to the first row that moves nothing has
    changed, so what was tried holds; the next block begins behind that row.
    """
    side, n_rows, n = side.copy(), len(sizes), float(len(codes))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    col = np.bincount(codes, minlength=n_forms).astype(np.float64)
    left = np.bincount(codes[np.repeat(side, sizes)], minlength=n_forms).astype(np.float64)
    used = col > 0
    q, held = float((left[used] ** 2 / col[used]).sum()), float(left.sum())
    count = [int((~side).sum()), int(side.sum())]

    def chi2(q: float, s: float) -> float:
        return n * n / (s * (n - s)) * (q - s * s / n) if 0 < s < n else 0.0

    now, block = chi2(q, held), 64
    for _ in range(passes):
        moved, at = False, 0
        while at < n_rows:
            to = min(n_rows, at + block)
            fs, size, here = codes[ends[at] : ends[to]], sizes[at:to], side[at:to]
            sign = np.where(here, -1.0, 1.0)
            gain = (2 * np.repeat(sign, size) * left[fs] + 1) / col[fs]
            some = size > 0
            q_new = np.full(to - at, q)
            if len(fs):
                q_new[some] += np.add.reduceat(gain, (ends[at:to] - ends[at])[some])
            s_new = held + sign * size
            inside = (s_new > 0) & (s_new < n)
            under = np.where(inside, s_new * (n - s_new), 1.0)
            then = np.where(inside, n * n / under * (q_new - s_new * s_new / n), 0.0)
            can = (then > now + 1e-9) & (np.where(here, count[1], count[0]) - 1 >= min_size)
            first = int(np.argmax(can)) if can.any() else -1
            if first < 0:
                at, block = to, min(2 * block, 1 << 16)
                continue
            k = at + first
            left[codes[ends[k] : ends[k + 1]]] += sign[first]
            count[int(side[k])] -= 1
            side[k] = not side[k]
            count[int(side[k])] += 1
            q, held, now, moved = float(q_new[first]), float(s_new[first]), float(then[first]), True
            at, block = k + 1, max(16, min(block, 2 * (first + 1)))
        if not moved:
            break
    return side


def _relocated(units: DataFrame, cells: DataFrame, d: Division) -> DataFrame:
    """(uce_id, left) after relocation; one task holds the class's sparse rows."""
    rows = units.join(cells.groupBy("uce_id").agg(F.collect_list("form").alias("fs")), "uce_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uce_id")
        names: dict[str, int] = {}
        lists = [np.array(sorted({names.setdefault(x, len(names)) for x in (fs if fs is not None else [])}), dtype=int) for fs in pdf["fs"]]
        side = relocate_rows(pdf["left"].to_numpy(dtype=bool), lists, len(names), d.min_class_size, d.max_passes)
        return pd.DataFrame({"uce_id": pdf["uce_id"], "left": side})

    return rows.withColumn("task", F.lit(1)).groupBy("task").applyInPandas(run, "uce_id string, left boolean")


def halves_chi2(halves: DataFrame, cells: DataFrame) -> float:
    """Chi-square of the two sides (uce_id, left) as they are."""
    counted = cells.join(halves, "uce_id").groupBy("form").agg(F.count_if("left").cast("double").alias("l"), F.count("*").cast("double").alias("c"))
    q, s, n = counted.agg(F.sum(F.col("l") * F.col("l") / F.col("c")), F.sum("l"), F.sum("c")).first()
    return float(n * n / (s * (n - s)) * (q - s * s / n)) if s and 0 < s < n else 0.0


@dataclass
class Classes:
    """``assign`` (uce_id, class), ``tree`` (node, parent, left, right, chi2, size, split_order, class), ``terms``."""

    assign: DataFrame
    tree: DataFrame
    terms: DataFrame


def _cut_of_cells(sizes: np.ndarray, codes: np.ndarray, n_forms: int, min_size: int) -> int:
    """The best cut of rows in order, as :func:`best_cut` has it."""
    n_rows, n = len(sizes), float(len(codes))
    column = np.bincount(codes, minlength=n_forms)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(len(codes))
    rank[order] = np.arange(len(codes)) - np.repeat(np.cumsum(column) - column, column)
    row = np.repeat(np.arange(n_rows), sizes)
    q = np.cumsum(np.bincount(row, weights=(2 * rank + 1) / column[codes], minlength=n_rows))[:-1]
    s = np.cumsum(sizes)[:-1].astype(np.float64)
    inside = (s > 0) & (s < n)
    chi2 = np.where(inside, n * n / np.where(inside, s * (n - s), 1.0) * (q - s * s / n), 0.0).round(9)
    low, high = max(min_size, 1), min(n_rows - min_size, n_rows - 1)
    if low <= high:
        return low + int(np.argmax(chi2[low - 1 : high]))
    return 1 + int(np.argmax(chi2)) if len(chi2) else 0


def divide_cells(sizes: np.ndarray, codes: np.ndarray, n_forms: int, d: Division) -> tuple[np.ndarray, dict[int, dict], dict[int, int]]:
    """(node of each row, tree, class of each last node) of rows that lie one after the other in ``codes``, in the order of their names."""
    n_rows = len(sizes)
    node_of = np.zeros(n_rows, dtype=np.int64)
    count = {0: n_rows}
    blank = {"parent": None, "left": None, "right": None, "chi2": None, "split_order": None}
    tree: dict[int, dict] = {0: blank | {"size": n_rows}}
    frozen: set[int] = set()
    n_splits = 0
    while len(count) < d.n_classes:
        open_ = [c for c in count if c not in frozen and count[c] >= 2 * d.min_class_size]
        if not open_:
            break
        node = max(open_, key=lambda c: count[c])
        members = np.flatnonzero(node_of == node)
        inside = np.repeat(node_of == node, sizes)
        held, own = codes[inside], sizes[members]
        column = np.bincount(held, minlength=n_forms)
        enough = column >= d.min_column
        if enough.any():
            kept = enough[held]
            own = np.bincount(np.repeat(np.arange(len(members)), own)[kept], minlength=len(members))
            held, column = held[kept], np.where(enough, column, 0)
        used = np.flatnonzero(column)
        place = np.zeros(n_forms, dtype=np.int32)
        place[used] = np.arange(len(used))
        held, column, v = place[held], column[used], len(used)
        row = np.repeat(np.arange(len(members), dtype=np.int32), own)
        some, compact = np.flatnonzero(own), np.cumsum(own > 0).astype(np.int32) - 1
        e = leading_vector(compact[row], held, len(some), v, TOLERANCE)
        if e[np.argmax(np.round(np.abs(e), 9))] < 0:
            e = -e
        weight = e / np.sqrt(column / len(held))
        axis = np.round(np.bincount(row, weights=weight[held], minlength=len(members)) / np.maximum(own, 1), 9) + 0.0
        order = np.argsort(axis, kind="stable")
        starts = np.cumsum(own) - own
        # cells in the order of the axis
        ordered = own[order]
        cells = np.arange(len(held)) - np.repeat(np.cumsum(ordered) - ordered, ordered) + np.repeat(starts[order], ordered)
        position = _cut_of_cells(ordered, held[cells], v, d.min_class_size)
        if not d.min_class_size <= position <= len(members) - d.min_class_size:
            frozen.add(node)
            continue
        side = np.zeros(len(members), dtype=bool)
        side[order[:position]] = True
        if d.relocate:
            side = relocate_cells(side, own, held, v, d.min_class_size, d.max_passes)
        found = {True: int(side.sum()), False: int((~side).sum())}
        if min(found.values()) < max(1, d.min_class_size):
            frozen.add(node)
            continue
        n_splits += 1
        l = np.bincount(held[side[row]], minlength=v).astype(np.float64)  # noqa: E741
        s, n = float(l.sum()), float(len(held))
        chi2 = n * n / (s * (n - s)) * (float((l * l / column).sum()) - s * s / n) if 0 < s < n else 0.0
        del count[node]
        a, b = len(tree), len(tree) + 1
        for k, is_left in ((a, True), (b, False)):
            count[k] = found[is_left]
            node_of[members[side == is_left]] = k
            tree[k] = blank | {"parent": node, "size": found[is_left]}
        tree[node] |= {"left": a, "right": b, "chi2": float(chi2), "split_order": n_splits}
    return node_of, tree, {c: i for i, c in enumerate(sorted(count, key=lambda c: -count[c]), start=1)}


_TREE = "node int, parent int, left int, right int, chi2 double, size long, split_order int, class int"


def _blocks(pairs: DataFrame) -> DataFrame:
    """(n, rows, forms, row, code): the cells in blocks with names of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_CELLS:
                yield _block(held)
                held, size = [], 0
        if size:
            yield _block(held)

    return pairs.select(F.col("uce_id").cast("string").alias("uce_id"), "form").mapInArrow(run, "n long, rows array<string>, forms array<string>, row binary, code binary")


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    rows, forms = (table.column(c).combine_chunks().dictionary_encode() for c in ("uce_id", "form"))
    row, code, _ = cells_of(rows.indices.to_numpy().astype(np.int64), forms.indices.to_numpy().astype(np.int64), len(forms.dictionary))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.string()))
    columns = [pa.array([len(row)], pa.int64()), one(rows.dictionary), one(forms.dictionary), *[pa.array([x.astype(np.uint32).tobytes()], pa.binary()) for x in (row, code)]]
    return pa.RecordBatch.from_arrays(columns, names=["n", "rows", "forms", "row", "code"])


def _whole(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(rows, forms, sizes, codes) of all blocks, both names in order and each cell once."""
    names, places = [], []
    for column in ("rows", "forms"):
        distinct = pa.chunked_array([x.values for x in table.column(column)], pa.string()).unique()
        ordered = distinct.take(pc.array_sort_indices(distinct))
        names.append(ordered)
        places.append([pc.index_in(x.values, value_set=ordered).to_numpy(zero_copy_only=False).astype(np.int64) for x in table.column(column)])
    read = lambda column, place: np.concatenate([m[np.frombuffer(x.as_py(), dtype=np.uint32)] for x, m in zip(table.column(column), place, strict=True)])
    key = np.unique(read("row", places[0]) * len(names[1]) + read("code", places[1]))
    row = key // len(names[1])
    return names[0], names[1], np.bincount(row, minlength=len(names[0])), (key % len(names[1])).astype(np.int32)


def _classified_in_one_task(blocks: DataFrame, d: Division) -> Classes:
    """All splits in one task, which holds the cells as codes: relocation goes row by row over the whole class there anyway."""
    spark = blocks.sparkSession
    fields = [x.split()[0] for x in _TREE.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows, forms, sizes, codes = _whole(table)
        if len(rows) < 4:
            node_of, tree, number = np.zeros(len(rows), dtype=np.int64), {}, {0: 1}
        else:
            node_of, tree, number = divide_cells(sizes, codes, len(forms), d)
        label = np.zeros(max(number) + 1, dtype=np.int64)
        label[list(number)] = list(number.values())
        own, k = label[node_of], len(number) + 1
        count = np.bincount(codes.astype(np.int64) * k + np.repeat(own, sizes), minlength=len(forms) * k)
        cell = np.flatnonzero(count)
        parts = [
            pa.table({"kind": pa.array(["row"] * len(rows)), "name": rows, "class": pa.array(own, pa.int32())}),
            pa.table({"kind": pa.array(["cell"] * len(cell)), "name": forms.take(pa.array(cell // k)), "class": pa.array(cell % k, pa.int32()), "size": pa.array(count[cell], pa.int64())}),
            pa.table({"kind": pa.array(["tree"] * len(tree), pa.string())} | {
                c: pa.array([i if c == "node" else number.get(i) if c == "class" else t[c] for i, t in tree.items()], pa.float64() if c == "chi2" else pa.int64() if c == "size" else pa.int32())
                for c in fields
            }),
        ]
        whole = pa.concat_tables(parts, promote_options="default")
        return whole.select(["kind", "name", *fields])

    found = blocks.withColumn("task", F.lit(1)).groupBy("task").applyInArrow(run, f"kind string, name string, {_TREE}").persist()
    tree = [tuple(r) for r in found.where("kind = 'tree'").select(*fields).collect()]
    if not tree:
        raise MatrixError(f"{found.where("kind = 'row'").count()} segments; 4 are needed")
    assign = found.where("kind = 'row'").select(F.col("name").alias("uce_id"), "class")
    cells = found.where("kind = 'cell'").select(F.col("name").alias("form"), "class", F.col("size").alias("n"))
    units = assign.groupBy("class").agg(F.count("*").alias("n_class"))
    return Classes(assign, spark.createDataFrame(tree, _TREE), characteristic_cells(cells, units))


def classify(pairs: DataFrame, d: Division = Division()) -> Classes:  # noqa: B008
    """Split the largest class that can be split until there are ``n_classes``.

    Classes are numbered by size.  ``pairs`` is (uce_id, form).  Up to
    ``MAX_TASK_CELLS`` one task makes all splits of cells as codes.  Beyond, what a
    split makes is checkpointed, so plans don't grow with the number of splits.
    """
    blocks = _blocks(pairs).persist()
    if (blocks.agg(F.sum("n")).first()[0] or 0) <= MAX_TASK_CELLS:
        return _classified_in_one_task(blocks, d)
    blocks.unpersist()
    spark = pairs.sparkSession
    checkpointing(spark)
    pairs = pairs.select(F.col("uce_id").cast("string").alias("uce_id"), "form").distinct().checkpoint()
    units = pairs.select("uce_id").distinct().checkpoint()
    live: dict[int, DataFrame] = {0: units}
    sizes = {0: units.count()}
    if sizes[0] < 4:
        raise MatrixError(f"{sizes[0]} segments; 4 are needed")
    tree: dict[int, dict] = {0: {"parent": None, "left": None, "right": None, "chi2": None, "size": sizes[0], "split_order": None}}
    frozen: set[int] = set()
    n_splits = 0
    while len(live) < d.n_classes:
        open_ = [c for c in live if c not in frozen and sizes[c] >= 2 * d.min_class_size]
        if not open_:
            break
        node = max(open_, key=lambda c: sizes[c])
        rows = live[node]
        cells = filter_columns(pairs.join(rows.select("uce_id"), "uce_id", "left_semi"), d.min_column).checkpoint()
        ordered = order_rows(rows, first_axis(cells)).checkpoint()
        position, _ = best_cut(ordered, cells, d.min_class_size)
        if not d.min_class_size <= position <= sizes[node] - d.min_class_size:
            frozen.add(node)
            continue
        halves = ordered.select("uce_id", (F.col("pos") <= position).alias("left"))
        if d.relocate:
            halves = _relocated(halves, cells, d)
        halves = halves.checkpoint()
        found = {r["left"]: r["n"] for r in halves.groupBy("left").agg(F.count("*").alias("n")).collect()}
        if len(found) < 2 or min(found.values()) < d.min_class_size:
            frozen.add(node)
            continue
        n_splits += 1
        chi2 = halves_chi2(halves, cells)
        del live[node]
        a, b = len(tree), len(tree) + 1
        for k, is_left in ((a, True), (b, False)):
            live[k] = halves.where(F.col("left") == is_left).select("uce_id")
            sizes[k] = found[is_left]
            tree[k] = {"parent": node, "left": None, "right": None, "chi2": None, "size": found[is_left], "split_order": None}
        tree[node] |= {"left": a, "right": b, "chi2": float(chi2), "split_order": n_splits}
    order = sorted(live, key=lambda c: -sizes[c])
    number = {c: i for i, c in enumerate(order, start=1)}
    assign = None
    for c, rows in live.items():
        part = rows.select("uce_id", F.lit(number[c]).alias("class"))
        assign = part if assign is None else assign.unionByName(part)
    assign = assign.checkpoint()
    table = [(k, t["parent"], t["left"], t["right"], t["chi2"], t["size"], t["split_order"], number.get(k)) for k, t in tree.items()]
    return Classes(assign, spark.createDataFrame(table, _TREE), characteristic_terms(pairs, assign))


def dendrogram(tree: DataFrame) -> DataFrame:
    """(node, x, height, label): leaves in order from left to right, inner nodes half-way, early splits high."""
    rows = {r["node"]: r.asDict() for r in tree.collect()}
    inner = sum(1 for r in rows.values() if r["left"] is not None)
    out, leaves = {}, []

    def walk(k: int) -> float:
        r = rows[k]
        if r["left"] is None:
            leaves.append(k)
            x, height, label = float(len(leaves) - 1), 0.0, f"class {r['class']} ({r['size']})"
        else:
            x = (walk(r["left"]) + walk(r["right"])) / 2
            height, label = float(inner - r["split_order"] + 1), ""
        out[k] = (k, x, height, label)
        return x

    walk(0)
    return tree.sparkSession.createDataFrame(list(out.values()), "node int, x double, height double, label string")


def stability(pairs: DataFrame, reference: DataFrame, d: Division = Division(), runs: int = 8, share: float = 0.85, seed: int = 0) -> DataFrame:  # noqa: B008
    """(within, between, stability): how often pairs of segments fall together in subsamples.

    Rates are taken pair by pair over the runs that hold both, then averaged over
    pairs of one reference class and of two.
    """
    ids = np.array(sorted(r["uce_id"] for r in pairs.select("uce_id").distinct().collect()))
    random = np.random.RandomState(seed)
    spark, together = pairs.sparkSession, None
    for run in range(runs):
        chosen = ids[np.sort(random.choice(len(ids), int(share * len(ids)), replace=False))]
        table = spark.createDataFrame([(str(x),) for x in chosen], "uce_id string")
        part = classify(pairs.join(table, "uce_id", "left_semi"), d).assign.withColumn("run", F.lit(run))
        together = part if together is None else together.unionByName(part)
    together = together.cache()
    left = together.select("run", F.col("uce_id").alias("a"), F.col("class").alias("ca"))
    right = together.select("run", F.col("uce_id").alias("b"), F.col("class").alias("cb"))
    rates = left.join(right, "run").where("a < b").groupBy("a", "b").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("rate"))
    ra = reference.select(F.col("uce_id").alias("a"), F.col("class").alias("ra"))
    rb = reference.select(F.col("uce_id").alias("b"), F.col("class").alias("rb"))
    both = rates.join(ra, "a").join(rb, "b")
    means = both.agg(F.avg(F.when(F.col("ra") == F.col("rb"), F.col("rate"))).alias("within"), F.avg(F.when(F.col("ra") != F.col("rb"), F.col("rate"))).alias("between"))
    return means.withColumn("stability", F.col("within") - F.col("between"))


__all__ = ["Classes", "Division", "adjusted_rand", "best_cut", "bipartition_chi2", "classify", "cut_scores", "dendrogram", "filter_columns", "first_axis", "order_rows", "positions", "relocate_rows", "stability"]
