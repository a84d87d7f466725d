"""Tails of whole numbers: the discrete power law and what it is held against, from the counts of distinct values.

The power law on x_min, x_min + 1, ... has the probabilities x^-a / zeta(a, x_min), with Hurwitz' zeta. Its exponent depends on the number of values and
the sum of their logarithms only, so the exponents of all bounds come from running sums over the table of counts, by Newton's steps a row. Alternatives on the
same support:

    exponential              proportional to e^(-lx)                       in closed form
    truncated_power_law      proportional to x^-a e^(-lx)                  from the sums of x and ln x
    lognormal                the normal law of ln x, from x - 1/2 to x + 1/2
    stretched_exponential    survival e^-((lx)^b), from x - 1/2 to x + 1/2

The last two have no such sums; their two parameters are found by zooming grids: each round is one pass over the counts that sums the likelihoods
of all points of both grids, and halves and moves the grids around their best points. No pass brings the counts to the driver or one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import discard, materialised

from .statistics import BOUNDS, VALUES, _upto

# Bernoulli numbers over factorials, from the second on, and terms summed one by one.
SERIES, TERMS = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160), 12
GRID, ZOOMS = 9, 24


def zeta(s, q):
    """Hurwitz' zeta of s > 1 (complex s too, for derivatives) and q > 0 by the Euler-Maclaurin sum."""
    s, q = np.asarray(s), np.asarray(q, float)
    total = reduce(lambda a, k: a + (q + k) ** -s, range(TERMS), 0)
    x = q + TERMS
    total = total + x ** (1 - s) / (s - 1) + 0.5 * x**-s
    rising, power = s, x ** (-s - 1)
    for k, b in enumerate(SERIES):
        total = total + b * rising * power
        rising, power = rising * (s + 2 * k + 1) * (s + 2 * k + 2), power / (x * x)
    return total


def _slope(s, q):
    """d ln zeta / ds: the imaginary part of a tiny imaginary step."""
    z = zeta(np.asarray(s) + 1e-30j, q)
    return (z.imag / z.real) / 1e-30


def exponents(n: np.ndarray, logs: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood exponents of tails of n values with sum of logarithms `logs` from low on, and their standard errors."""
    mean = logs / n
    a = 1 + 1 / np.maximum(mean - np.log(low - 0.5), 1e-9)
    a = np.clip(a, 1 + 1e-6, 60)
    bend = lambda a: (_slope(a + 1e-4, low) - _slope(a - 1e-4, low)) / 2e-4
    for _ in range(40):
        step = (_slope(a, low) + mean) / bend(a)
        a = np.clip(a - np.clip(step, -(a - 1) / 2, 1.0), 1 + 1e-6, 60)
    return a, 1 / np.sqrt(n * bend(a))


def discrete_power_law(df: DataFrame, value: str, least_tail: int = 10, exact: bool = True) -> DataFrame:
    """One row: alpha, sigma, low, high (95 %), x_min, distance, tail of the best discrete power law over positive whole numbers.

    The bound of least Kolmogorov-Smirnov distance wins, then the least bound. Not `exact`: the closed form 1 + n / sum ln(x / (x_min - 1/2)), with
    sigma (alpha - 1) / sqrt n, as common libraries have it. Without a bound that `least_tail` values reach all columns but tail (0) are null.
    """
    cells = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("c"))
    tails = materialised(_upto(cells), "tails")
    most, size = tails.agg(F.max("v"), F.count("*")).first()

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            n, logs, low = (t[c].to_numpy(float) for c in ("n", "logs", "v"))
            a, e = exponents(n, logs, low)
            if not exact:
                a = 1 + n / (logs - n * np.log(low - 0.5))
                e = (a - 1) / np.sqrt(n)
            yield pd.DataFrame({"low": low, "tail": n, "alpha": a, "sigma": e})

    bounds = tails.where((F.col("n") >= least_tail) & (F.col("v") < F.lit(most))).mapInPandas(fit, "low double, tail double, alpha double, sigma double")
    bounds = materialised(bounds, "bounds")
    blocks, groups = max(1, math.ceil(size / VALUES)), max(1, math.ceil(size / BOUNDS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = bounds.withColumn("group", deal("low", groups)).withColumn("block", every(blocks))
    right = tails.select("v", "c", "n").withColumn("block", deal("v", blocks)).withColumn("group", every(groups))

    def distances(b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        v, past = t["v"].to_numpy(float), (t["n"] - t["c"]).to_numpy(float)
        for low, tail, alpha in zip(b["low"], b["tail"], b["alpha"]):
            up = v >= low
            gap = np.abs(zeta(alpha, v[up] + 1) / zeta(alpha, low) - past[up] / tail)
            out.append((low, gap.max() if len(gap) else -1.0))
        return pd.DataFrame(out, columns=["low", "d"])

    worst = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(distances, "low double, d double").groupBy("low").agg(F.max("d").alias("d"))
    best = bounds.join(worst, "low").agg(F.min_by(F.struct("alpha", "sigma", "low", "d", "tail"), F.struct(F.round("d", 12), F.col("low"))).alias("b"))
    a, e = F.col("b.alpha"), F.col("b.sigma")
    return best.select(
        a.alias("alpha"), e.alias("sigma"), (a - 1.96 * e).alias("low"), (a + 1.96 * e).alias("high"), F.col("b.low").alias("x_min"), F.col("b.d").alias("distance"),
        F.coalesce(F.col("b.tail"), F.lit(0)).cast("long").alias("tail"),
    )


def _log_erfc(x: np.ndarray) -> np.ndarray:
    """ln of the complementary error function, where it is far below what a double holds by its series."""
    x = np.asarray(x, float)
    y = np.maximum(x, 10.0) ** -2
    far = -(np.maximum(x, 10.0) ** 2) + 0.5 * np.log(y / math.pi) + np.log1p(y * (-0.5 + y * (0.75 - 1.875 * y)))
    return np.where(x > 10, far, np.log(np.vectorize(math.erfc, otypes=[float])(np.minimum(x, 10.0))))


def _log_lognormal(v, low, mu, sigma):
    """ln of the probability of v, from logarithms of tails, so that far values keep their digits."""
    up = lambda x: _log_erfc((np.log(x) - mu) / (sigma * math.sqrt(2)))
    a, b = up(v - 0.5), up(v + 0.5)
    return a + np.log(np.maximum(-np.expm1(b - a), 1e-300)) - float(up(low - 0.5))


def _log_stretched(v, low, rate, bend):
    a, b = (rate * (v - 0.5)) ** bend, (rate * (v + 0.5)) ** bend
    return -a + np.log(np.maximum(-np.expm1(a - b), 1e-300)) + (rate * (low - 0.5)) ** bend


def _truncated_sum(alpha: float, rate: float, low: float) -> float:
    """ln of the sum of x^-alpha e^(-rate (x - low)) over x >= low: terms, then an integral by Simpson's rule in ln x."""
    x = low + np.arange(4000)
    head = (x**-alpha * np.exp(-rate * (x - low))).sum()
    u = np.linspace(math.log(x[-1] + 0.5), math.log(x[-1] + 0.5 + 60 / max(rate, 1e-12)), 4001)
    f = np.exp((1 - alpha) * u - rate * (np.exp(u) - low))
    return math.log(head + (u[1] - u[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))


def _zoom(likelihood, centre: tuple[float, float], reach: float = 4.0, rounds: int = ZOOMS) -> tuple[float, float]:
    """Where a function of two grids of parameters (arrays in, array out) is greatest."""
    for _ in range(rounds):
        a, b = (g.ravel() for g in np.meshgrid(*[np.linspace(c - reach, c + reach, GRID) for c in centre], indexing="ij"))
        k = int(np.nanargmax(likelihood(a, b)))
        centre, reach = (float(a[k]), float(b[k])), reach / 2
    return centre


def fit_truncated(n: float, logs: float, total: float, low: float, alpha: float) -> tuple[float, float]:
    """alpha and rate of the truncated power law from count, sum of logarithms and sum."""

    def likelihood(a, b):
        rate = np.exp(b)
        return np.array([-x * logs - r * (total - n * low) - n * _truncated_sum(x, r, low) if -2 < x < 40 else -np.inf for x, r in zip(a, rate)])

    a, b = _zoom(likelihood, (alpha, math.log(n / max(total - n * low, 1e-9)) - 3), 6.0, 30)
    return a, math.exp(b)


def tail_ratios(df: DataFrame, value: str, x_min: float, alpha: float) -> DataFrame:
    """(alternative, ratio, p, first, second): normalised log-likelihood ratios of the discrete power law against four alternatives.

    ratio > 0 speaks for the power law. p: how likely a ratio so far from 0 is by chance; for the truncated power law, which holds the power law as a
    case, from the chi-squared law of twice the raw ratio. first, second: the alternative's parameters (rate; alpha and rate; mu and sigma; rate and exponent).
    """
    cells = materialised(df.where(F.col(value) >= x_min).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("c")), "cells")
    c, v = F.col("c"), F.col("v")
    n, total, logs, squares = cells.agg(F.sum("c"), F.sum(c * v), F.sum(c * F.ln(v)), F.sum(c * F.ln(v) * F.ln(v))).first()
    schema = "alternative string, ratio double, p double, first double, second double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    low = float(x_min)
    rate = math.log1p(n / max(total - n * low, 1e-9))
    cut = fit_truncated(n, logs, total, low, alpha)

    def sums(of) -> np.ndarray:
        """The sums over all cells of c times the rows of of(v)."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in parts:
                if len(t):
                    x = (of(t["v"].to_numpy()) * t["c"].to_numpy()).sum(axis=1)
                    yield pd.DataFrame({"k": np.arange(len(x)), "x": np.maximum(x, -1e300)})

        rows = cells.mapInPandas(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()  # a row a grid point
        return np.array([r.x for r in rows])

    mean, spread = logs / n, max(math.sqrt(max(squares / n - (logs / n) ** 2, 0)), 0.05)
    points = {"lognormal": (mean, math.log(spread)), "stretched_exponential": (math.log(n / total), 0.0)}
    laws = {"lognormal": lambda v, a, b: _log_lognormal(v, low, a, math.exp(b)), "stretched_exponential": lambda v, a, b: _log_stretched(v, low, math.exp(a), math.exp(b))}
    reach = 4.0
    for _ in range(ZOOMS):
        grids = {k: [g.ravel() for g in np.meshgrid(*[np.linspace(x - reach, x + reach, GRID) for x in at], indexing="ij")] for k, at in points.items()}
        with_all = lambda v, grids=grids: np.stack([laws[k](v, a, b) for k, g in grids.items() for a, b in zip(*g)])
        found = sums(with_all).reshape(len(points), -1)
        for k, row in zip(points, found):
            best = int(np.nanargmax(row))
            points[k] = float(grids[k][0][best]), float(grids[k][1][best])
        reach /= 2
    log_zeta, log_cut = math.log(float(zeta(alpha, low))), _truncated_sum(*cut, low)
    every = {
        "exponential": lambda v: math.log(-math.expm1(-rate)) - rate * (v - low),
        "truncated_power_law": lambda v: -cut[0] * np.log(v) - cut[1] * (v - low) - log_cut,
        "lognormal": lambda v: laws["lognormal"](v, *points["lognormal"]),
        "stretched_exponential": lambda v: laws["stretched_exponential"](v, *points["stretched_exponential"]),
    }

    def gaps(v):
        d = [-alpha * np.log(v) - log_zeta - f(v) for f in every.values()]
        return np.stack([*d, *(x * x for x in d)])

    raw, square = sums(gaps).reshape(2, -1)
    told = {"exponential": (rate, None), "truncated_power_law": cut, "lognormal": (points["lognormal"][0], math.exp(points["lognormal"][1])), "stretched_exponential": tuple(map(math.exp, points["stretched_exponential"]))}
    out = []
    for name, r, q in zip(every, raw.tolist(), square.tolist()):
        sigma = math.sqrt(max(q / n - (r / n) ** 2, 0.0))
        ratio = r / (math.sqrt(n) * sigma) if sigma else 0.0
        p = math.erfc(math.sqrt(abs(r))) if name == "truncated_power_law" else math.erfc(abs(ratio) / math.sqrt(2))
        out.append((name, ratio, p, *map(lambda x: None if x is None else float(x), told[name])))
    discard(cells)
    return df.sparkSession.createDataFrame(out, schema)
