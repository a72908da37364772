"""Numeric expressions that Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0 by the Lanczos approximation, to about 15 digits."""
    x = n.cast("double")
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], start=1):
        series = series + F.lit(c) / (x + F.lit(float(k)))
    t = x + F.lit(_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + F.lit(0.5)) * F.ln(t) - t + F.ln(series)


def log_choose(n: Column, k: Column) -> Column:
    """ln of the number of k-subsets of n."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def tail_sums(k: np.ndarray, total: np.ndarray, row: np.ndarray, column: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Sum of the tail's terms over its first, by the ratio of neighbouring terms, all rows at once.

    A row is done where its terms no longer count, about nine standard
    deviations from the mean, or at the end of the range.
    """
    k, total, row, column = (np.asarray(x, dtype=np.float64) for x in (k, total, row, column))
    last = np.where(upper, np.minimum(row, column), np.maximum(0.0, column - (total - row)))
    at, term, acc = k.copy(), np.ones(len(k)), np.ones(len(k))
    live = np.flatnonzero(at != last)
    while len(live):
        x, r, c, rest, up = at[live], row[live], column[live], (total - row - column)[live], upper[live]
        rise = (r - x) * (c - x) / ((x + 1) * np.where(up, rest + x + 1, 1.0))
        fall = x * (rest + x) / ((r - x + 1) * (c - x + 1))
        term[live] *= np.where(up, rise, fall)
        acc[live] += term[live]
        at[live] += np.where(up, 1.0, -1.0)
        live = live[(at[live] != last[live]) & (term[live] > 1e-17 * acc[live])]
    return acc


def _tail_udf(k: pd.Series, total: pd.Series, row: pd.Series, column: pd.Series, upper: pd.Series) -> pd.Series:
    return pd.Series(tail_sums(k.to_numpy(), total.to_numpy(), row.to_numpy(), column.to_numpy(), upper.to_numpy(dtype=bool)))


def hypergeometric_tail(k: Column, total: Column, row: Column, column: Column, upper: Column | bool) -> Column:
    """P(X >= k), or P(X <= k), of drawing ``column`` cells of ``total`` of which ``row`` count; k lies on the tail's side of the mean.

    The first term comes from log-factorials in the JVM, the sum of the others,
    for which expressions would build an array a row, from numpy by Arrow batches.
    """
    log_first = log_choose(row, k) + log_choose(total - row, column - k) - log_choose(total, column)
    side = F.lit(upper) if isinstance(upper, bool) else upper
    return F.exp(log_first) * F.pandas_udf(_tail_udf, T.DoubleType())(k, total, row, column, side)
