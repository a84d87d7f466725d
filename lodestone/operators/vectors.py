"""Nearest neighbours by cosine distance: filtered, batched, per document, more like this."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import cosine_distance

from .tables import top_k


BLOCK, ASKED, FEW = 16384, 16384, 64


def batch_knn(queries: DataFrame, points: DataFrame, k: int, qid: str = "query_id", pid: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(qid, pid, rank, distance): the k nearest points of each query, ties to the smaller id, itself left out.

    Points are dealt into blocks of about BLOCK and queries into groups of about ASKED by hashes of their ids; each pair of a block and
    a group is one product of two bounded matrices in double precision, and only k points a query and block go on. Vectors that are
    null or zero, hold a null, or differ in length from the query have no distance and never show.
    """
    p = points.where(where) if where is not None else points
    p = p.where(F.col(vector).isNotNull()).select(F.col(pid).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks, groups = (max(1, math.ceil(n / most)) for n, most in ((p.count(), BLOCK), (q.count(), ASKED)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.withColumn("block", deal(blocks)).withColumn("group", every(groups))
    q = q.withColumn("group", deal(groups)).withColumn("block", every(blocks))
    kinds = f"{qid} {queries.schema[qid].dataType.simpleString()}, {pid} {points.schema[pid].dataType.simpleString()}, distance double"

    def sized(t: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and unit vectors by length."""
        out: dict[int, list] = {}
        for i, v in zip(t["id"], t["v"]):
            v = np.asarray(v, float)
            n = np.sqrt((v * v).sum())
            if n > 0:
                out.setdefault(len(v), []).append((i, v / n))
        return {d: (np.array([i for i, _ in rows]), np.stack([v for _, v in rows])) for d, rows in out.items()}

    def meet(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out, here = [], sized(block)
        for d, (ids, x) in sized(asked).items():
            if d not in here:
                continue
            own, y = here[d]
            for at in range(0, len(x), 256):
                for i, far in zip(ids[at : at + 256], 1 - x[at : at + 256] @ y.T):
                    far = np.where(own == i, np.inf, far)
                    near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
                    near = near[np.lexsort((own[near], far[near]))][:k]
                    out += [(i, own[j], far[j]) for j in near if far[j] < np.inf]
        return pd.DataFrame(out, columns=[qid, pid, "distance"])

    near = q.groupBy("block", "group").cogroup(p.groupBy("block", "group")).applyInPandas(meet, kinds)
    return top_k(near, [qid], [F.col("distance"), F.col(pid)], k)


def distances(queries: DataFrame, points: DataFrame, qid: str = "query_id", pid: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(qid, pid, distance and the points' columns of `keep`) of every point to each of at most FEW queries, itself left out: one scan without a shuffle.

    The queries, no more than FEW, become literals of the plan; more are an error, batch_knn is for those.
    """
    asked = queries.select(qid, F.col(vector).cast("array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null)").limit(FEW + 1).collect()
    if len(asked) > FEW:
        raise ValueError(f"more than {FEW} queries; use batch_knn or an index")
    p = points.where(F.col(vector).isNotNull()).select(pid, F.col(vector).cast("array<double>").alias("_v"), *keep)
    if not asked:
        return p.select(F.lit(None).cast(queries.schema[qid].dataType).alias(qid), pid, F.lit(None).cast("double").alias("distance"), *keep).limit(0)
    of = [F.struct(F.lit(i).cast(queries.schema[qid].dataType).alias("i"), F.when(F.size("_v") == len(v), cosine_distance(F.col("_v"), F.array(*map(F.lit, v)))).alias("d")) for i, v in asked]
    met = p.select(pid, *keep, F.explode(F.array(*of)).alias("_q")).select(F.col("_q.i").alias(qid), pid, F.col("_q.d").alias("distance"), *keep)
    return met.where((F.col("distance").isNotNull()) & (F.col(qid) != F.col(pid)))


def few_knn(queries: DataFrame, points: DataFrame, k: int, qid: str = "query_id", pid: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """batch_knn for at most FEW queries, without Python: each partition keeps its k best of a query."""
    p = points.where(where) if where is not None else points
    return top_k(distances(queries, p, qid, pid, vector), [qid], [F.col("distance"), F.col(pid)], k)


def knn(points: DataFrame, query: list[float], k: int, pid: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(pid, distance) of the k nearest to one vector."""
    p = points.where(where) if where is not None else points
    q = F.array(*[F.lit(float(x)) for x in query])
    return p.select(pid, cosine_distance(F.col(vector), q).alias("distance")).where("distance is not null").orderBy("distance", pid).limit(k)


def parent_id(chunk_id: Column) -> Column:
    """The document of a chunk: what stands before the last _chunk_ or _fact_ number."""
    return F.regexp_replace(chunk_id, r"_(?:chunk|fact)_[^_]*$", "")


def relevance(distance: Column) -> Column:
    return F.round(1 - distance, 6)


def one_hit_a_document(queries: DataFrame, points: DataFrame, document: str, k: int, qid: str = "query_id", pid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, document, pid, distance, rank): the best hit of each document for each of at most FEW queries, the best k of those.

    Every point counts: each partition first keeps the best hit of a document, so no list of hits is ever cut before its documents are known.
    """
    met = distances(queries, points, qid, pid, vector, keep=(document,))
    best = met.groupBy(qid, document).agg(F.min(F.struct("distance", pid)).alias("b")).select(qid, document, F.col(f"b.{pid}").alias(pid), F.col("b.distance").alias("distance"))
    return top_k(best, [qid], [F.col("distance"), F.col(pid)], k)


def passes(mats: Column, tc_min: float | None = None, pressure_max: float | None = None) -> Column:
    """Search filters over nested records: any value at least tc_min; any pressure at most pressure_max, where a null one passes."""
    ok = F.lit(True)
    if tc_min is not None:
        ok &= F.exists(mats, lambda m: m["tc_kelvin"] >= tc_min)
    if pressure_max is not None:
        ok &= F.exists(mats, lambda m: m["pressure_gpa"].isNull() | (m["pressure_gpa"] <= pressure_max))
    return F.coalesce(ok, F.lit(False))


def more_like_this(chunks: DataFrame, document: str, of, k: int, pid: str = "vec_id", vector: str = "embedding", take: int = 20) -> DataFrame:
    """(document, similarity): documents nearest to the given ones by the mean distance of the hits of their chunks."""
    own = chunks.where(F.col(document).isin(*of)).orderBy(pid).limit(take).select(F.col(pid).alias("query_id"), F.col(document).alias("_own"), vector)
    hits = batch_knn(own.select("query_id", vector), chunks, k + 5, "query_id", pid, vector)
    named = hits.join(chunks.select(pid, document), pid).where(~F.col(document).isin(*of))
    mean = named.groupBy(document).agg(F.avg("distance").alias("d"), F.count("*").alias("hits"))
    return mean.orderBy("d", document).limit(k).select(document, relevance(F.col("d")).alias("similarity"), "hits")

