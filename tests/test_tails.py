"""Discrete tails against slow references, and bootstrap intervals against draws of whole items."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import agreement, statistics, tails


def plain_zeta(s, q):
    n = 200_000
    x = q + np.arange(n)
    return float((x**-s).sum() + (q + n) ** (1 - s) / (s - 1) - 0.5 * (q + n) ** -s + (q + n) ** -s)


def test_zeta():
    for s, q in ((1.5, 1), (2.0, 1), (2.5, 7), (3.7, 40), (1.05, 3)):
        assert float(tails.zeta(s, q)) == pytest.approx(plain_zeta(s, q), rel=1e-6)
    assert float(tails.zeta(2.0, 1)) == pytest.approx(math.pi**2 / 6, rel=1e-13)


def drawn(alpha, low, n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.arange(low, 200_000)
    p = x**-alpha
    return rng.choice(x, size=n, p=p / p.sum()).tolist()


def frame(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "x int")


def golden(f, a, b):
    for _ in range(120):
        c, d = a + 0.382 * (b - a), a + 0.618 * (b - a)
        a, b = (a, d) if f(c) > f(d) else (c, b)
    return (a + b) / 2


def test_the_exponent_and_bound_of_a_discrete_power_law(spark):
    values = drawn(2.6, 4, 4000) + [1] * 900 + [2] * 900 + [3] * 300
    got = tails.discrete_power_law(frame(spark, values).repartition(7), "x").first()
    best = []
    for low in sorted(set(values))[:-1]:
        tail = [v for v in values if v >= low]
        if len(tail) < 10:
            continue
        logs = sum(map(math.log, tail))
        a = golden(lambda a: -a * logs - len(tail) * math.log(float(tails.zeta(a, low))), 1.01, 12)
        x = np.array(sorted(set(tail)), float)
        past = np.array([sum(v > y for v in tail) for y in x]) / len(tail) if low < 30 else None
        if past is not None:
            best.append((round(float(np.abs(tails.zeta(a, x + 1) / tails.zeta(a, low) - past).max()), 9), low, a, len(tail)))
    d, low, a, n = min(best)
    assert got.x_min == low and got.tail == n and got.alpha == pytest.approx(a, abs=1e-5) and got.distance == pytest.approx(d, abs=1e-6)
    assert got.low < 2.6 < got.high and got.high - got.alpha == pytest.approx(1.96 * got.sigma)
    near = tails.discrete_power_law(frame(spark, values), "x", exact=False).first()
    assert near.alpha == pytest.approx(got.alpha, abs=0.05) and near.sigma == pytest.approx((near.alpha - 1) / math.sqrt(near.tail))
    assert tails.discrete_power_law(frame(spark, []), "x").first().tail == 0


def slow_ratio(values, low, alpha, law, start):
    """Normalised ratio and raw ratio against a law(v, first, second) of log-probabilities, its parameters by coordinate search."""
    x = np.array(sorted(values), float)
    at, step = list(start), 1.0
    score = lambda p: float(law(x, *p).sum())
    while step > 1e-9:
        moved = max(([at[0] + i * step, at[1] + j * step] for i in (-1, 0, 1) for j in (-1, 0, 1)), key=score)
        if score(moved) > score(at):
            at = moved
        else:
            step /= 2
    d = -alpha * np.log(x) - math.log(float(tails.zeta(alpha, low))) - law(x, *at)
    return d.sum() / (math.sqrt(len(x)) * d.std()), d.sum(), at


@pytest.mark.parametrize("kind", ["power", "lognormal"])
def test_four_alternatives(spark, kind):
    rng = np.random.default_rng(8)
    low, alpha = 3, 2.2
    values = [v for v in (drawn(2.2, 3, 1500) if kind == "power" else np.exp(rng.normal(2.2, 0.7, 1500)).round().astype(int).tolist()) if v >= low]
    got = {r.alternative: r for r in tails.tail_ratios(frame(spark, values).repartition(5), "x", low, alpha).collect()}
    x = np.array(values, float)

    def check(name, law, start, second=True):
        ratio, raw, at = slow_ratio(values, low, alpha, law, start)
        r = got[name]
        assert r.ratio == pytest.approx(ratio, abs=2e-3)
        return r, raw, at

    r, raw, _ = check("exponential", lambda v, a, _: np.log(-np.expm1(-np.exp(a))) - np.exp(a) * (v - low), (-2.0, 0.0))
    assert r.p == pytest.approx(math.erfc(abs(r.ratio) / math.sqrt(2)), abs=1e-9) and r.second is None
    erfc = np.vectorize(math.erfc)
    up = lambda v, mu, s: 0.5 * erfc((np.log(v) - mu) / (math.exp(s) * math.sqrt(2)))
    log_normal = lambda v, mu, s: np.log(np.maximum(up(v - 0.5, mu, s) - up(v + 0.5, mu, s), 1e-300)) - math.log(max(up(low - 0.5, mu, s), 1e-250))
    if kind == "lognormal":  # on power-law data its likelihood has no maximum, only a ridge
        r, _, at = check("lognormal", log_normal, (float(np.log(x).mean()), -0.5))
        assert r.first == pytest.approx(at[0], abs=0.01) and r.ratio < -5 and r.p < 1e-4
    else:
        assert got["lognormal"].p > 0.01 or got["lognormal"].ratio > 0
    survive = lambda v, a, b: np.exp(-((math.exp(a) * v) ** math.exp(b)))
    if kind == "lognormal":
        check("stretched_exponential", lambda v, a, b: np.log(np.maximum(survive(v - 0.5, a, b) - survive(v + 0.5, a, b), 1e-300)) - np.log(survive(low - 0.5, a, b)), (-2.0, 0.0))
    many = np.arange(low, 400_000, dtype=float)
    cut = lambda v, a, b: -a * np.log(v) - math.exp(b) * (v - low) - math.log((many**-a * np.exp(-math.exp(b) * (many - low))).sum())
    r = got["truncated_power_law"]  # along a ridge the plain search may stop early: what was found is no worse, and its ratio is right
    own = cut(x, r.first, math.log(r.second))
    assert own.sum() >= cut(x, *slow_ratio(values, low, alpha, cut, (2.0, -4.0))[2]).sum() - 1e-4
    d = -alpha * np.log(x) - math.log(float(tails.zeta(alpha, low))) - own
    assert r.ratio == pytest.approx(d.sum() / (math.sqrt(len(x)) * d.std()), abs=2e-3) and r.p == pytest.approx(math.erfc(math.sqrt(abs(d.sum()))), abs=2e-3)


def test_bootstrap_of_a_mean_has_the_interval_of_plain_draws(spark):
    rng = np.random.default_rng(2)
    values = rng.gamma(2.0, 3.0, 900).round(1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = statistics.bootstrap(df, "v", replicates=1500).first()
    means = [rng.choice(values, len(values)).mean() for _ in range(1500)]
    assert got["mean"] == pytest.approx(values.mean())
    assert got.low == pytest.approx(np.percentile(means, 2.5), abs=0.06) and got.high == pytest.approx(np.percentile(means, 97.5), abs=0.06)
    again = statistics.bootstrap(df.repartition(9), "v", replicates=1500).first()
    assert (again.low, again.high) == (pytest.approx(got.low), pytest.approx(got.high))


def plain_alpha(items, nominal=True):
    """Krippendorff's alpha from all pairs of labels."""
    items = [i for i in items if len(i) > 1]
    far = (lambda a, b: float(a != b)) if nominal else (lambda a, b: (a - b) ** 2)
    every = [v for i in items for v in i]
    n = len(every)
    seen = sum(2 * sum(far(a, b) for a, b in combinations(i, 2)) / (len(i) - 1) for i in items) / n
    count = Counter(every)
    chance = sum(far(a, b) * count[a] * count[b] for a in count for b in count) / (n * (n - 1))
    return 1 - seen / chance if chance else math.nan


@pytest.mark.parametrize("nominal", [True, False])
def test_the_interval_of_alpha_is_that_of_drawn_items(spark, nominal):
    rng = random.Random(4)
    items = []
    for _ in range(150):
        true = rng.randint(1, 4)
        items.append([true if rng.random() < 0.7 else rng.randint(1, 4) for _ in range(rng.choice([1, 2, 3, 3, 4]))])
    rows = [(k, v) for k, i in enumerate(items) for v in i] + [(999, None)]
    df = spark.createDataFrame(rows, "item int, label int")
    got = agreement.alpha_interval(df, "item", "label", interval=not nominal, replicates=600).first()
    assert got.alpha == pytest.approx(plain_alpha(items, nominal), abs=1e-5) and got["items"] == sum(len(i) > 1 for i in items)
    some = [i for i in items if len(i) > 1]
    boots = [plain_alpha([rng.choice(some) for _ in some], nominal) for _ in range(400)]
    assert got.low == pytest.approx(np.percentile(boots, 2.5), abs=0.03) and got.high == pytest.approx(np.percentile(boots, 97.5), abs=0.03)
    assert agreement.alpha_interval(df.repartition(7), "item", "label", interval=not nominal, replicates=600).first() == got
    few = agreement.alpha_interval(df.where("item < 4"), "item", "label", interval=not nominal, replicates=50).first()
    assert math.isnan(few.low) and math.isnan(few.high)


def test_agreement_of_a_model_with_itself(spark):
    rng = random.Random(5)
    rows, items = [], {"m": [], "n": []}
    for model, noise in (("m", 0.1), ("n", 0.5)):
        for paper in range(40):
            real = [f"f{k}" for k in range(rng.randint(0, 4))]
            runs = [{f for f in real if rng.random() > noise} for _ in range(3)]
            for r, found in enumerate(runs):
                if paper == 7 and r == 2:
                    continue  # a run is missing, so the paper doesn't count
                rows += [(model, paper, r, f) for f in found] or [(model, paper, r, None)]
            if paper != 7:
                items[model] += [[int(f in found) for found in runs] for f in sorted(set().union(*runs))]
    df = spark.createDataFrame(rows + rows[:5], "model string, paper int, run int, formula string")
    got = {r.model: r for r in agreement.set_alpha(df, "run", "paper", "formula", 3, ["model"], replicates=300).collect()}
    for model, of in items.items():
        assert got[model].alpha == pytest.approx(plain_alpha(of), abs=1e-5) and got[model]["items"] == len(of) and got[model].papers == 39
        assert got[model].low < got[model].alpha < got[model].high
    one = agreement.set_alpha(df.where("model = 'm'"), "run", "paper", "formula", 3).first()
    assert one.alpha == got["m"].alpha
