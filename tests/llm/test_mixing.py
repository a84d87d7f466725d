import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing


def plain_targets(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def corpus(n=3000, seed=6):
    rng = random.Random(seed)
    names = ["hot"] * 8 + ["b", "a", None, "É", "zz", "tiny"]
    return [(i, rng.choice(names), " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, rng.randint(1, 900)])))) for i in range(n)]


def test_targets_and_taken(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.digests(df).collect()
    again = {r.doc_id: r.taken for r in mixing.digests(df.repartition(7)).collect()}
    assert len(got) == len(rows) and {r.doc_id: r.taken for r in got} == again
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    sizes = {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = plain_targets(sizes), {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.002 * want[s]), s


def dual(sizes, target, cap=2.0):
    """b of one source with prior 1 by bisection in plain Python."""
    mean = sum(sizes) / len(sizes)
    low, high = -500.0, 500.0
    for _ in range(300):
        b = (low + high) / 2
        words = sum(s * min(cap, math.exp(min(700.0, b * s / mean))) for s in sizes if s)
        low, high = (b, high) if words < target else (low, b)
    return b


def test_rates_solve_the_dual_and_reach_the_target(spark):
    rng = random.Random(4)
    kinds = {"a": [rng.randint(0, 400) for _ in range(300)], "b": [rng.choice([1, 2, 3, 5000]) for _ in range(300)], "c": [7] * 200}
    times = (0.01, 0.2, 0.9, 1.0, 1.3, 1.6, 1.7, 1.8, 1.9, 1.99, 1.9999)
    sizes = {f"{k}{t}": own for k, own in kinds.items() for t in times} | {None: kinds["a"]}
    want = {s: (float(s[1:]) if s else 0.5) * sum(own) for s, own in sizes.items()}
    docs = spark.createDataFrame([(k, s, n) for s, own in sizes.items() for k, n in enumerate(own)], "doc_id long, source string, size long")
    cells = docs.groupBy("source", "size").agg(F.lit(1.0).alias("prior"), F.count("*").alias("n"))
    goals = spark.createDataFrame([(s, sum(own), len(own), want[s]) for s, own in sizes.items()], "source string, source_size long, n_docs long, target double")
    got = {r.source: r.b for r in mixing.solve(cells, goals).collect()}
    assert set(got) == set(sizes)
    for s, own in sizes.items():
        assert got[s] == pytest.approx(dual(own, want[s]), rel=1e-5, abs=1e-7)


def test_sources_just_below_the_cap_reach_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, s, rng.randint(1, 300) + 3000 * (i % 97 == 0)) for s, n in (("a", 160), ("b", 900), ("c", 500)) for i in range(n)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long"), share=1.9).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 20
    assert any(1.5 < r.target / r.source_size < 2 for r in got)


def test_a_target_out_of_reach_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 10, 1.0), (2, "a", 90, 0.0), (3, "b", 100, 1.0)], "doc_id long, source string, size long, prior double")
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.copies(docs, prior="prior", share=0.9)


def test_a_very_long_text(spark):
    rows = [(i, "a" if i % 2 else "b", "w " * (400_000 if i == 3 else 3 + i)) for i in range(60)]
    got = mixing.digests(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, _, t in rows}
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 * max(r.size for r in own)


def test_a_source_that_the_prior_leaves_nothing_of_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 50, 0.0), (2, "a", 50, None), (3, "b", 100, 1.0), (4, "b", 70, 1.0)], "doc_id long, source string, size long, prior double")
    with pytest.raises(RuntimeError, match="'a' has a target"):
        mixing.copies(docs, prior="prior", share=0.9)


def test_a_prior_tilts_and_the_constraint_still_holds(spark):
    rows = [(i, "ab"[i % 2], 1 + i * 7 % 90, 0.2 + (i % 5) * 0.4) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, prior double")
    got = mixing.copies(df, prior="prior", share=1.2).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.01 * own[0].target
    mean = lambda p: sum(r.copies for r in got if r.prior == p) / 800
    assert mean(0.2) < mean(1.0)


def test_cases(spark):
    rows = [(1, None, None, 1), (2, "s", "", 2), (3, "s", "a b", 3), (3, "s", "a b", 3), (None, "s", "a b c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target int")
    got = mixing.digests(df).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.digests(df.limit(0)).count() == 0
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0


def test_rows_without_an_id_are_mixed_one_by_one(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 else i, "ab"[i % 2], f"t{i} " + "w " * rng.randint(0, 60)) for i in range(600)] + [(9001, "a", "x y z"), (9001, "a", "other words " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(r.text for r in mixing.mix(df).collect())
    again = sorted(r.text for r in mixing.mix(df.repartition(7)).collect())
    assert got == again
    words = lambda texts, s: sum(len(t.split()) for t in texts if s is None or source[t] == s)
    source = {t: s for _, s, t in rows}
    want = plain_targets({s: words(source, s) for s in "ab"})
    assert all(abs(words(got, s) - want[s]) <= 10 for s in "ab")
    assert max(got.count(t) for t in {*got}) <= 2
    nulls = [t for d, _, t in rows if d is None]
    assert len({got.count(t) for t in nulls}) > 1
