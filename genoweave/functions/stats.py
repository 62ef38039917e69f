"""Statistics as Column expressions. Only the normal tail needs a pandas function: there is no erf in Spark."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-10
#: ln 0! to ln 15!, as one expression: a literal for each would take the driver longer than the query.
_SMALL = f"array({', '.join(f'{math.lgamma(n + 1)!r}D' for n in range(16))})"


def num(x: float) -> Column:
    return F.lit(float(x))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: a table up to 15, then Stirling's series (error below 1e-14 of the value)."""
    x = n.cast("double") + 1.0
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv * (num(1 / 12) - inv2 * (num(1 / 360) - inv2 * (num(1 / 1260) - inv2 * num(1 / 1680))))
    stirling = (x - 0.5) * F.ln(x) - x + num(0.5 * math.log(2 * math.pi)) + series
    return F.when(n < 16, F.element_at(F.expr(_SMALL), (n + 1).cast("int"))).otherwise(stirling)


def log_hypergeometric(i: Column, carriers: Column, drawn: int, population: int) -> Column:
    """ln P(X = i) when `drawn` of `population` are drawn and `carriers` of them are marked, for an i that is possible."""
    fixed = math.lgamma(drawn + 1) + math.lgamma(population - drawn + 1) - math.lgamma(population + 1)
    up = log_factorial(carriers) + log_factorial(population - carriers)
    down = log_factorial(i) + log_factorial(carriers - i) + log_factorial(drawn - i) + log_factorial(population - carriers - drawn + i)
    return up - down + num(fixed)


def hypergeometric_tail(x: Column, carriers: Column, drawn: Column, population: Column) -> Column:
    """P(X >= x), term by term: for few rows, such as modules. An impossible tail is 0. For many see network.tail_table."""
    lo = F.greatest(x.cast("long"), F.lit(0).cast("long"), (drawn - (population - carriers)).cast("long"))
    hi = F.least(carriers.cast("long"), drawn.cast("long"))
    fixed = log_factorial(carriers) + log_factorial(population - carriers) - log_factorial(population) + log_factorial(drawn) + log_factorial(population - drawn)

    def term(i: Column) -> Column:
        return F.exp(fixed - log_factorial(i) - log_factorial(carriers - i) - log_factorial(drawn - i) - log_factorial(population - carriers - drawn + i))

    terms = F.aggregate(F.sequence(lo, hi), num(0), lambda total, i: total + term(i))
    return F.when(lo <= hi, terms).otherwise(num(0))


def minus_log10(p: Column) -> Column:
    """-log10 p; +inf at 0 (Spark's own is null)."""
    return F.when(p <= 0, num(float("inf"))).otherwise(-F.log10(p))


def interaction_score(p11: Column, p10: Column, p01: Column, p00: Column, alpha1: float = 0.05, alpha2: float = 0.05) -> Column:
    """-log10 of p11 against the least of the others; 0 unless p11 passes alpha1 and no other passes alpha2."""
    if alpha1 >= 1:
        raise ValueError("alpha1 must be below 1")
    a, b, c, d = p11 + EPS, p10 + EPS, p01 + EPS, p00 + EPS
    fail = (a > alpha1) | (b <= alpha2) | (c <= alpha2) | (d <= alpha2)
    return F.when(fail, num(0)).otherwise(F.greatest(-F.log10(a / F.least(b, c, d)), num(0)))


def chi2_stat(a: Column, b: Column, c: Column, d: Column) -> Column:
    """2 x 2 chi-square without correction; null where the table is no evidence (a = 0, a negative cell, an empty margin)."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    below = (a + b) * (c + d) * (a + c) * (b + d)
    bad = (a <= 0) | (b < 0) | (c < 0) | (d < 0) | (below == 0)
    return F.when(~bad, F.try_divide((a + b + c + d) * F.pow(a * d - b * c, F.lit(2)), below))


def mann_whitney_z(rank_in: Column, n_in: Column, n_out: Column, ties: Column) -> Column:
    """z of the one-sided test (greater), tie-corrected, with continuity; null where the variance isn't positive."""
    n1, n2 = n_in.cast("double"), n_out.cast("double")
    n = n1 + n2
    var = n1 * n2 * (n + 1.0 - F.try_divide(ties.cast("double"), n * (n - 1.0))) / 12.0
    return F.when(var > 0, (rank_in - n1 * (n1 + 1.0) / 2.0 - n1 * n2 / 2.0 - 0.5) / F.sqrt(var))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z); 1 for a missing z. Runs on module rows only."""
    return z.map(lambda v: 1.0 if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > stat); 1 for a missing stat."""
    return stat.map(lambda v: 1.0 if pd.isna(v) else math.erfc(math.sqrt(v / 2.0)))


def midrank(rank: Column, ties: Column) -> Column:
    return rank + (ties - 1) / 2.0
