import numpy as np
import pytest

from lodestone.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int"


def exact(rows, top=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    d = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), -n)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == d]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted(((-float(x @ v), i) for i, v in ok if i != q))[:top]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[rng.integers(40)] + rng.normal(size=32) * rng.choice([0.2, 1])).tolist()) for i in range(6000)]
    rows += [(i, rows[0][1]) for i in range(6000, 6400)]
    want = exact(rows)
    got = {}
    for r in neighbours.search(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [k for k, _, _ in near] == list(range(1, 21))
        hits += len({i for _, i, _ in near} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [i for _, i, _ in got[6000]] == [i for _, i in want[6000]]
    assert got[20][0][2] == pytest.approx(-want[20][0][0], rel=1e-12)


def test_scores_of_double_vectors_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=9).tolist(), "x") for i in range(300)]
    of = {i: np.array(v) for i, v, _ in rows}
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")).collect()
    assert len(got) == 15 * 20 and all(r.score == pytest.approx(of[r.query_id] @ of[r.vec_id], rel=1e-13) for r in got)


def test_parallel_residuals_are_smaller_than_with_plain_quantisation(monkeypatch):
    x = np.random.default_rng(3).normal(size=(1500, 64))

    def along(q):
        r = q.cut(x) - q.codewords[np.arange(32), q.encode(x)]
        u = q.cut(x) / np.linalg.norm(x, axis=1)[:, None, None]
        return ((r * u).sum(axis=(1, 2)) ** 2).mean()

    aware = along(neighbours.fit(x))
    monkeypatch.setattr(neighbours, "eta", lambda d: 1.0)
    assert aware < along(neighbours.fit(x))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (40, [0.0, 0.0]), (7, [-3.0, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [None, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.search(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA)).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (0, 3, 7), (20, 1, 0), (20, 2, 1), (20, 3, 7)]
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_vectors_of_one_id_are_two_queries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(40)]
    again = rng.normal(size=4).tolist()
    got = neighbours.search(spark.createDataFrame([*rows, (20, again, 0), (20, again, 0)], SCHEMA)).collect()
    want = []
    for v in (rows[20][1], again):
        x = np.array(v, np.float32).astype(float)
        near = sorted((-float(x @ np.array(w, np.float32).astype(float)), i) for i, w in [*((i, w) for i, w, _ in rows), (20, again)] if i != 20 or w != v)[:20]
        want += [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 20) == sorted(want)
