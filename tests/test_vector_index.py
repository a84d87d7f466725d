"""The vector index against exact distances: recall, inserts, filters, copies, the exact way."""

import numpy as np
import pytest

from lodestone.operators.vector_index import VectorIndex, fresh_path
from pyspark.sql import functions as F


def exact(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i, v in asked:
        far = 1 - x @ (np.array(v) / np.linalg.norm(v))
        out[i] = [int(ids[j]) for j in np.lexsort((ids, far)) if ids[j] != i][:k]
    return out


def told(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    return {q: [i for _, i in sorted(v)] for q, v in got.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, i % 4) for i, v in rows], "vec_id long, embedding array<double>, kind int")


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[rng.integers(60)] + 0.4 * rng.normal(size=16)).tolist()) for i in range(4000)]
    index = VectorIndex.build(frame(spark, rows[:3000]), fresh_path(spark, "index"), keep=("kind",), leaf=40)
    index.insert(frame(spark, rows[3000:]).repartition(3))
    asked = rows[::40]
    return rows, index, asked, spark.createDataFrame(asked, "query_id long, embedding array<double>")


def test_all_cells_probed_is_exact(world):
    rows, index, asked, queries = world
    assert told(index.search(queries, 7, 1.0)) == exact(rows, asked, 7)


def test_a_share_of_the_cells_finds_most(world):
    rows, index, asked, queries = world
    want = exact(rows, asked, 10)
    some = {p: recall(told(index.search(queries, 10, p)), want) for p in (0.1, 0.3, 0.6)}
    assert some[0.1] < some[0.3] < some[0.6] and some[0.3] > 0.9
    share = index.calibrate(10, 0.9, 100)
    assert 0 < share < 0.6 and recall(told(index.search(queries, 10, share + 1e-9)), want) > 0.86
    assert all(r.distance == pytest.approx(1, abs=1) for r in index.search(queries, 3, 0.1).collect())


def test_inserted_vectors_are_found_also_by_a_loaded_index(spark, world):
    rows, index, asked, queries = world
    late = spark.createDataFrame([(-i, v) for i, v in rows[3000::50]], "query_id long, embedding array<double>")
    again = VectorIndex.load(spark, index.path)
    found = told(again.search(late, 1, 0.05))
    assert found == {-i: [i] for i, _ in rows[3000::50]}
    assert again.vectors().count() == 4000 and again.vectors().select("leaf", "root").where("leaf is null or root is null").count() == 0


def test_filters_hold_inside_the_search(world):
    rows, index, asked, queries = world
    got = told(index.search(queries, 5, 1.0, where=F.col("kind") == 1))
    assert got == exact([r for r in rows if r[0] % 4 == 1], asked, 5)


def test_copies_ties_and_vectors_that_take_no_part(spark, monkeypatch):
    from lodestone.operators import vector_index

    monkeypatch.setattr(vector_index, "BLOCK", 30)  # the leaf of the copies is many parts
    rng = np.random.default_rng(6)
    same = rng.normal(size=5).tolist()
    rows = [(i, same) for i in range(200)] + [(i, rng.normal(size=5).tolist()) for i in range(200, 300)]
    odd = [(900, None, 0), (901, [0.0] * 5, 0), (902, [1.0, None, 1.0, 1.0, 1.0], 0), (903, [float("nan")] * 5, 0), (904, [1.0], 0), (None, [1.0] * 5, 0), (905, [], 0)]
    df = frame(spark, rows).unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<double>, kind int"))
    index = VectorIndex.build(df, fresh_path(spark, "copies"), leaf=10)
    asked = [*rows[::60], (901, [0.0] * 5)]
    got = told(index.search(spark.createDataFrame(asked, "query_id long, embedding array<double>"), 4, 1.0))
    assert got == exact(rows, rows[::60], 4) and index.vectors().count() == 300


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = VectorIndex.build(empty, fresh_path(spark, "none"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3).count() == 0
    with pytest.raises(ValueError):
        index.insert(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))


def test_queries_come_in_slices(spark, tmp_path, monkeypatch):
    """More queries than a slice holds, and pieces smaller than a batch, give the same rows."""
    from lodestone.operators import vector_index as V

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.withColumnRenamed("vec_id", "query_id")
    index = V.VectorIndex.build(df, str(tmp_path / "index"), leaf=20)
    whole = sorted(map(tuple, index.search(asked, 5, 1.0).collect()))
    monkeypatch.setattr(V, "ASKS", 50)
    monkeypatch.setattr(V, "PIECE", 200)
    out = index.search(asked, 5, 1.0)
    assert "slice" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == whole and len(whole) == 2_000
