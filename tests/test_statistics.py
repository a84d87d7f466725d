"""Statistics, vectors and agreement against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import agreement, evidence, statistics, summary, vectors


def test_poisson_tail_of_any_size(spark):
    cases = [(0, 3.0), (3, 3.0), (10, 3.0), (500, 480.0), (480, 500.0), (199, 250.0), (201, 200.0), (5000, 5100.0), (5200, 5100.0), (3, 0.0), (100, 3.0), (1, 700.0)]
    df = spark.createDataFrame([(i, k, m) for i, (k, m) in enumerate(cases)], "i int, k int, m double")
    got = [r.p for r in df.orderBy("i").select(statistics.poisson_lower_tail(F.col("k"), F.col("m")).alias("p")).collect()]

    def plain(k, m):
        return sum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k + 1)) if m > 0 else 1.0

    for (k, m), p in zip(cases, got):
        assert p == pytest.approx(plain(k, m), rel=1e-8, abs=1e-300), (k, m)


def test_valley_test(spark):
    rng = random.Random(1)
    values = [rng.uniform(30, 40) for _ in range(400)] + [rng.uniform(50, 80) for _ in range(300)] + [rng.uniform(80, 95) for _ in range(500)]
    got = {r.metric: r.value for r in statistics.valley_test(spark.createDataFrame([(v,) for v in values], "v double"), "v", (30, 40), (50, 80), (80, 95)).collect()}
    assert (got["n_left"], got["n_valley"], got["n_right"]) == (400, 300, 500)
    assert got["expected"] == pytest.approx(math.sqrt(40 * 500 / 15) * 30, rel=1e-6) and got["p_bonferroni"] == pytest.approx(min(1, 8 * got["p_raw"]))
    for w in (5, 10, 15):
        bins = lambda a, b: [sum(x <= v < x + w for v in values) for x in range(a, b - w + 1, w)]  # noqa: E731, B023
        assert got[f"depth_{w}"] == pytest.approx(min(bins(50, 80)) / max(bins(30, 40) + bins(80, 95)), abs=1e-6)
    rho = 10 / min(40, 500 / 15)
    assert got["depth_ci_low"] < rho < got["depth_ci_high"]


def test_power_law_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    values = np.floor(5 * rng.random(4000) ** (-1 / 1.6)).astype(int)
    got = statistics.power_law(spark.createDataFrame([(int(v),) for v in values], "k long"), "k").first()
    best = None
    v, c = np.unique(values, return_counts=True)
    for k, low in enumerate(v[:-1]):
        n = c[k:].sum()
        if n < 10:
            break
        a = 1 + n / (c[k:] * np.log(v[k:] / (low - 0.5))).sum()
        d = np.abs(np.cumsum(c[k:]) / n - 1 + ((v[k:] + 0.5) / (low - 0.5)) ** (1 - a)).max()
        if best is None or d < best[2]:
            best = (a, low, d, n)
    assert (got.alpha, got.x_min, got.distance, got.tail) == (pytest.approx(best[0]), best[1], pytest.approx(best[2]), best[3])
    ratio = statistics.tail_ratio(spark.createDataFrame([(int(v),) for v in values], "k long"), "k", got.x_min, got.alpha).first()
    assert ratio.ratio > 0 and 0 <= ratio.p < 1e-3


def test_median_of_counts(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *map(float, range(9))]) if k != "x" else None) for k in "abcx" for _ in range(rng.randint(1, 40))]
    got = {r.k: r["median"] for r in evidence.exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    want = {k: float(np.median([v for q, v in rows if q == k and v is not None])) for k in {k for k, v in rows if v is not None}}
    assert got == want


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "ASKED", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(230)] + [(500, [0.0] * 6), (501, None), (502, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.batch_knn(df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), df, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 6 and any(v)}
    for q in range(0, 230, 10):
        want = sorted((1 - ok[q] @ v, i) for i, v in ok.items() if i != q)[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert set(got) == set(range(0, 230, 10))


def test_stability_scorecard_and_jitter(spark):
    rows = [("m", "p", r, x) for r in range(3) for x in "ab"] + [("m", "q", 0, "a"), ("m", "q", 1, "b"), ("m", "q", 2, "c"), ("m", "q", 2, "d")]
    got = agreement.run_stability(spark.createDataFrame(rows, "model string, paper string, run int, item string"), "model", "paper", "run", "item").first()
    assert (got.papers, got.stable, got.distinct, got.mean_outputs, got.pairs, got.identical, got.count_diff, got.median_dn) == (2, 1, 1, 2.0, 6, 3, 2, 1.0)
    h = 2166136261
    for c in "MgB2":
        h = (h ^ ord(c)) * 16777619 % 2**32
    assert spark.range(1).select(text.jitter(F.lit("MgB2")).alias("j")).first().j == h / 2**32 - 0.5
    s = spark.createDataFrame(
        [("MgB2", "mgb2", "mgb2", 39.0, None, "experimental", False, None, 2), ("Mg B2", "mgb-2", None, None, 9.0, "experimental", True, "cuprate_123", 1)],
        "formula string, formula_normalized string, family string, tc_max_experimental double, tc_max_theoretical double, dominant_evidence string, needs_review boolean, structure_phase string, total_papers int",
    )
    got = {r.metric: r.value for r in summary.scorecard(s).collect()}
    assert got == {"rows": 2, "needs_review": 1, "visible": 1, "rejectable": 0, "theory_headline": 1, "phase_inconsistent": 1, "null_family_with_papers": 1, "near_duplicate_clusters": 1}
