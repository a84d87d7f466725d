"""Statistics on few numbers: bootstrap intervals, power-law tails, density valleys. Spark gathers counts, replicates are tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialised


def bootstrap(df: DataFrame, value: str, weight_seed: int = 42, replicates: int = 1000) -> DataFrame:
    """One row: mean and the 2.5 and 97.5 percentiles of its bootstrap means.

    Poisson bootstrap: each distinct value gets a Poisson(count) weight in every replicate, drawn from a hash of (seed, replicate,
    value), so results do not depend on partitions. Only (value, count) pairs and sums a replicate are moved.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s = np.zeros(replicates), np.zeros(replicates)
        for part in parts:
            for v, c in zip(part["v"], part["c"]):
                k = np.random.default_rng([weight_seed, np.float64(v).view(np.uint64)]).poisson(c, replicates)
                w += k
                s += k * v
        yield pd.DataFrame({"rep": np.arange(replicates), "w": w, "s": s})

    means = cells.mapInPandas(draw, "rep int, w double, s double").groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return cells.agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).join(ci, F.lit(True))


VALUES, BOUNDS, RANGE = 4096, 1024, 16


def _upto(cells: DataFrame) -> DataFrame:
    """cells (v, c) with n and logs: count and sum of c ln v of the values from v on. Sums run inside ranges of v; a row a range gives the rest."""
    ranges = materialised(cells.repartitionByRange("v").withColumn("_range", F.spark_partition_id()), "values")
    log = F.col("c") * F.ln("v")
    whole = ranges.groupBy("_range").agg(F.sum("c").alias("_c"), F.sum(log).alias("_l"))
    after = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    later = whole.select("_range", *[F.coalesce(F.sum(x).over(after), F.lit(0.0)).alias(x) for x in ("_c", "_l")])
    inside = Window.partitionBy("_range").orderBy(F.col("v").desc())
    return ranges.join(later, "_range").select("v", "c", (F.sum("c").over(inside) + F.col("_c")).alias("n"), (F.sum(log).over(inside) + F.col("_l")).alias("logs"))


def power_law(df: DataFrame, value: str, least_tail: int = 10) -> DataFrame:
    """One row: exponent, lower bound, distance and tail size of the best power law over positive whole numbers.

    The maximum-likelihood exponent (continuous, shifted by 1/2) of every lower bound comes from sums over the counts of distinct
    values; the bound of least Kolmogorov-Smirnov distance wins, then the least bound. Distances are taken in bounded matrices, a block
    of values against a group of bounds, so neither the values nor the bounds meet in one task.
    """
    cells = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("c"))
    tails = materialised(_upto(cells), "tails")
    most, size = tails.agg(F.max("v"), F.count("*")).first()
    spread = F.col("logs") - F.col("n") * F.ln(F.col("v") - 0.5)
    bounds = tails.where((F.col("n") >= least_tail) & (F.col("v") < F.lit(most)) & (spread > 0)).select(F.col("v").alias("low"), F.col("n").alias("tail"), (1 + F.col("n") / spread).alias("alpha"))
    blocks, groups = max(1, math.ceil(size / VALUES)), max(1, math.ceil(size / BOUNDS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = bounds.withColumn("group", deal("low", groups)).withColumn("block", every(blocks))
    right = tails.select("v", "c", "n").withColumn("block", deal("v", blocks)).withColumn("group", every(groups))

    def distances(b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        low, tail, alpha = (b[x].to_numpy()[:, None] for x in ("low", "tail", "alpha"))
        v, past = t["v"].to_numpy()[None], (t["n"] - t["c"]).to_numpy()[None]
        if not v.size or not low.size:
            return pd.DataFrame({"low": [], "d": []})
        gap = np.abs((np.maximum(v + 0.5, low - 0.5) / (low - 0.5)) ** (1 - alpha) - past / tail)
        return pd.DataFrame({"low": low[:, 0], "d": np.where(v >= low, gap, -1.0).max(axis=1)})

    worst = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(distances, "low double, d double").groupBy("low").agg(F.max("d").alias("d"))
    best = bounds.join(worst, "low").agg(F.min_by(F.struct("alpha", "low", "d", "tail"), F.struct(F.round("d", 12), F.col("low"))).alias("b"))
    return best.select(F.col("b.alpha").alias("alpha"), F.col("b.low").alias("x_min"), F.col("b.d").alias("distance"), F.coalesce(F.col("b.tail"), F.lit(0)).cast("long").alias("tail"))


def _erfc(z: Column) -> Column:
    """Complementary error function of z >= 0, to seven places."""
    t = 1 / (1 + 0.3275911 * z)
    # Coefficients of the approximation.
    poly = reduce(lambda a, c: a * t + c, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    return poly * t * F.exp(-z * z)


def tail_ratio(df: DataFrame, value: str, x_min: float, alpha: float) -> DataFrame:
    """One row: ratio, the log-likelihood of the power law over that of an exponential tail of the same bound, and p, how likely a ratio
    so far from 0 is by chance; positive speaks for the power law. Sums over counts of distinct values in two passes."""
    m = x_min - 0.5
    cells = df.where(F.col(value) >= x_min).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("c"))
    mean = cells.agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"))
    rate = 1 / (F.col("mean") - m)
    gap = F.ln(F.lit((alpha - 1) / m)) - alpha * F.ln(F.col("v") / m) - (F.ln(rate) - rate * (F.col("v") - m))
    s = cells.join(mean, F.lit(True)).withColumn("g", gap).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("g")).alias("r"), F.sum(F.col("c") * F.col("g") * F.col("g")).alias("q"))
    spread = F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("r") / F.col("n"), 2))
    return s.select(F.col("r").alias("ratio"), _erfc(F.abs("r") / (F.sqrt(2 * F.col("n")) * spread)).alias("p"))


def histogram(df: DataFrame, value: str, width: float, out: str = "bin") -> DataFrame:
    """(bin, n): lower edges of fixed-width bins and their counts; empty bins do not show."""
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias(out)).agg(F.count("*").alias("n"))


def valleys(bins: DataFrame, at: str = "bin", n: str = "n", near: float = 5, far: float = 30) -> DataFrame:
    """Every bin with the highest bin on either side between near and far, and depth = n / the lower of the two. Null places do not show.

    The axis is cut into ranges of RANGE times far; a bin also goes, as a guest, to the ranges that its halo of far reaches, so each range is a window of
    its own.
    """
    cell = lambda x: F.floor(x / (RANGE * far)).cast("long")
    x = F.col(at)
    dealt = bins.withColumn("_range", F.explode(F.sequence(cell(x - far), cell(x + far))))
    w = Window.partitionBy("_range").orderBy(at)
    left, right = F.max(n).over(w.rangeBetween(-far, -near)), F.max(n).over(w.rangeBetween(near, far))
    own = dealt.withColumns({"left_peak": left, "right_peak": right}).where(F.col("_range") == cell(x)).drop("_range")
    return own.withColumn("depth", F.round(F.try_divide(F.col(n), F.least("left_peak", "right_peak")), 4))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 1: Stirling's series, eight places up."""
    y = x + 8
    shift = reduce(lambda a, i: a * (x + i), range(1, 8), x)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - F.ln(shift)


def _series(n: Column, ratio) -> Column:
    """1 + r(1) + r(1) r(2) + ... of n terms after the first."""
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), zero, step)["sum"]).otherwise(1.0)


def poisson_lower_tail(k: Column, mean: Column) -> Column:
    """P(X <= k) for a Poisson mean, any k: the terms from k down, or one minus those from k + 1 up, each until they no longer count."""
    k, mean = k.cast("double"), mean.cast("double")
    probability = lambda i: F.exp(i * F.ln(mean) - mean - _log_gamma(i + 1))
    reach = lambda x: F.ceil(40 + 12 * F.sqrt(x)).cast("int")
    below = probability(k) * _series(F.least(k.cast("int"), reach(k)), lambda i: (k - i + 1) / mean)
    above = probability(k + 1) * _series(reach(mean), lambda i: mean / (k + 1 + i))
    return F.when(k < 0, 0.0).when(mean <= 0, 1.0).when(k <= mean, below).otherwise(1 - above)


def valley_test(df: DataFrame, value: str, left: tuple[float, float], valley: tuple[float, float], right: tuple[float, float], candidates: int = 8,
                widths: tuple[int, ...] = (5, 10, 15), replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(metric, value) of a gap between two peaks of a distribution.

    Counts and densities of the three ranges [from, to); the count expected in the valley if its density were the geometric mean of the
    peaks'; the Poisson lower tail, raw and times `candidates` (Bonferroni, 1 at most); for each bin width, the least valley bin over
    the highest peak bin; the 95 % interval of valley density over the lower peak density by `replicates` Poisson resamplings of the
    three counts. One pass over df; all else is on a row of counts.
    """
    v = F.col(value)
    inside = lambda r: (v >= r[0]) & (v < r[1])
    names, ranges = ("left", "valley", "right"), (left, valley, right)
    every = {f"n_{n}": F.count_if(inside(r)) for n, r in zip(names, ranges)}
    bins = {w: [[(a, min(a + w, r[1])) for a in np.arange(r[0], r[1], w).tolist() if a + w <= r[1]] for r in ranges] for w in widths}
    for w, of in bins.items():
        for n, cut in zip(names, of):
            every |= {f"b_{w}_{n}_{j}": F.count_if(inside(x)) for j, x in enumerate(cut)}
    one = df.agg(*[c.cast("double").alias(n) for n, c in every.items()])
    rate = {n: F.col(f"n_{n}") / (r[1] - r[0]) for n, r in zip(names, ranges)}
    expected = F.sqrt(rate["left"] * rate["right"]) * (valley[1] - valley[0])
    out = {**{f"n_{n}": F.col(f"n_{n}") for n in names}, **{f"density_{n}": F.round(rate[n], 6) for n in names}, "expected": F.round(expected, 6)}
    out["p_raw"] = poisson_lower_tail(F.col("n_valley"), expected)
    out["p_bonferroni"] = F.least(F.lit(1.0), out["p_raw"] * candidates)
    for w, (lefts, lows, rights) in bins.items():
        cols = lambda n, cut: [F.col(f"b_{w}_{n}_{j}") for j in range(len(cut))]  # noqa: E731, B023
        peaks, low = cols("left", lefts) + cols("right", rights), cols("valley", lows)
        out[f"depth_{w}"] = F.round(F.try_divide(F.array_min(F.array(*low)), F.array_max(F.array(*peaks))), 6) if peaks and low else F.lit(None).cast("double")

    def resampled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for l, m, r in zip(t["n_left"], t["n_valley"], t["n_right"]):
                rng = np.random.default_rng(seed)
                x = [rng.poisson(n, replicates) / (b - a) for n, (a, b) in zip((l, m, r), ranges)]
                low = np.minimum(x[0], x[2])
                rho = x[1][low > 0] / low[low > 0]
                a, b = np.percentile(rho, [2.5, 97.5]) if len(rho) else (math.nan, math.nan)
                yield pd.DataFrame({"metric": ["depth_ci_low", "depth_ci_high"], "value": [a, b]})

    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in out.items()])
    rows = one.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")
    return rows.unionByName(one.select("n_left", "n_valley", "n_right").mapInPandas(resampled, "metric string, value double"))


def density(bins: DataFrame, at: str, n: str, grid: list[float], bandwidth: float) -> DataFrame:
    """(x, density): a Gaussian kernel over counted values at the points of a grid."""
    g = F.explode(F.array(*map(F.lit, map(float, grid)))).alias("x")
    kernel = F.exp(-F.pow((F.col("x") - F.col(at)) / bandwidth, 2) / 2) / (bandwidth * math.sqrt(2 * math.pi))
    return bins.select(at, n, g).groupBy("x").agg((F.sum(F.col(n) * kernel) / F.sum(n)).alias("density"))
