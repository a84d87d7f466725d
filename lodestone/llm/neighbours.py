"""Approximate maximum inner product search with score-aware (anisotropic) product quantisation.

A vector is cut into pairs of components; each pair is one of 16 codewords, four bits. Codewords and codes minimise
    |r|^2 + (ETA(d) - 1) (r . x/|x|)^2,   r = x - codeword sum,
so the residual along the vector, which shifts its inner products with the queries it is near to, costs more than the
residual across it. Codes are set by coordinate descent over the pairs, codewords by the weighted least squares of
that loss. A query is looked up in tables: its products with the codewords, joined to tables of 256 for two
codes (one byte), summed over the bytes of each code; the RERANK best of a block of vectors are ranked again by their exact
inner products in double precision.

The codebooks are fitted on at most FIT_ROWS vectors, taken by the hash of vec_id; every vector is indexed and scanned. Vectors
are dealt into blocks by a hash, and every query meets every block, a bounded matrix at a time; per query and block the best TOP + 1 go
on, merged FAN blocks at a time. A small table has up to SPREAD blocks, so that several tasks share the work, a large one
blocks of about BLOCK: up to SPREAD * BLOCK vectors the queries sent are a fixed multiple of the table.

Equal vectors are searched once. Of a group of copies only the TOP + 1 least ids can ever be among the TOP nearest, and the
window that picks them limits each partition before its shuffle, so a vector that a third of all rows share is no hot group.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do vectors of another
length than the commonest (the lesser of equals); rows with a null vec_id take no part; rows repeated with vec_id and vector
count once; rows of one vec_id with different vectors are queries of their own (with ranks of their own under the one query_id) and candidates
like others, also of each other; a query with fewer than TOP candidates gets all; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

TOP, EVERY, RERANK, BLOCK, SPREAD, FAN = 20, 20, 200, 65536, 8, 64
FIT_ROWS, ROUNDS, SWEEPS, THRESHOLD = 12_000, 8, 2, 0.2


def eta(d: int) -> float:
    """Weight of the parallel residual for inner products above THRESHOLD times the norms."""
    return max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


class Quantiser:
    """codewords: (pairs, 16, 2)."""

    def __init__(self, codewords: np.ndarray, dims: int):
        self.codewords, self.dims = codewords, dims

    def cut(self, x: np.ndarray) -> np.ndarray:
        """(n, pairs, 2), padded with a zero component if the length is odd."""
        if x.shape[1] % 2:
            x = np.column_stack([x, np.zeros(len(x))])
        return x.reshape(len(x), -1, 2).astype(np.float64)

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """(n, pairs) codes by coordinate descent on the loss."""
        v = self.cut(x)
        u = v / np.sqrt((v * v).sum(axis=(1, 2)))[:, None, None]
        more, pairs = eta(self.dims) - 1, v.shape[1]
        if codes is None:
            codes = np.empty(v.shape[:2], np.int64)
            for j in range(pairs):
                codes[:, j] = ((v[:, j, None, :] - self.codewords[j][None]) ** 2).sum(-1).argmin(1)
        r = v - self.codewords[np.arange(pairs), codes]
        along = (r * u).sum(axis=(1, 2))
        for _ in range(SWEEPS):
            for j in range(pairs):
                rest = along - (r[:, j] * u[:, j]).sum(1)
                tried = v[:, j, None, :] - self.codewords[j][None]
                part = (tried * u[:, j, None, :]).sum(-1)
                codes[:, j] = ((tried**2).sum(-1) + more * (rest[:, None] + part) ** 2).argmin(1)
                r[:, j] = tried[np.arange(len(v)), codes[:, j]]
                along = rest + (r[:, j] * u[:, j]).sum(1)
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if codes.shape[1] % 2:
            codes = np.column_stack([codes, np.zeros(len(codes), codes.dtype)])
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256) float32: the product of each query with what a byte of codes stands for."""
        t = np.einsum("npk,pck->npc", self.cut(queries), self.codewords)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(t), 1, 16))], axis=1)
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(t), -1, 256).astype(np.float32)


def fit(x: np.ndarray) -> Quantiser:
    """Codewords of a bounded sample."""
    q = Quantiser(np.empty(0), x.shape[1])
    rng = np.random.default_rng(11)
    v = q.cut(x)
    n, pairs, _ = v.shape
    u = v / np.sqrt((v * v).sum(axis=(1, 2)))[:, None, None]
    more = eta(x.shape[1]) - 1
    q.codewords = np.stack([v[rng.integers(0, n, 16), j] + rng.normal(0, 1e-6, (16, 2)) for j in range(pairs)])
    codes = None
    for _ in range(ROUNDS):
        codes = q.encode(x, codes)
        r = v - q.codewords[np.arange(pairs), codes]
        along = (r * u).sum(axis=(1, 2))
        for j in range(pairs):
            rest = along - (r[:, j] * u[:, j]).sum(1)
            outer = np.eye(2)[None] + more * u[:, j, :, None] * u[:, j, None, :]
            goal = v[:, j] + more * u[:, j] * (rest + (v[:, j] * u[:, j]).sum(1))[:, None]
            for c in range(16):
                own = codes[:, j] == c
                if own.any():
                    q.codewords[j, c] = np.linalg.solve(outer[own].sum(0), goal[own].sum(0))
                else:
                    q.codewords[j, c] = v[rng.integers(0, n), j]
            r[:, j] = v[:, j] - q.codewords[j, codes[:, j]]
            along = rest + (r[:, j] * u[:, j]).sum(1)
    return q


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, greatest first, ties to the lesser id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    given = vectors.schema[vector].dataType.elementType.simpleString()
    kind = given if given in ("float", "double") else "double"
    v = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(fine)
    common = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("embedding") == (common["d"] if common else 0))


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = valid(vectors, key, vector)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = written(rows.distinct().withColumn("place", F.row_number().over(copies)).where(F.col("place") <= top + 1), "vectors")
    firsts = written(kept.where("place = 1").select("vec_id", "embedding").withColumn("node", F.monotonically_increasing_id()), "firsts")
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    queries = written(queries.join(firsts.select("embedding", F.col("node").alias("first")), "embedding").select("query_id", "first", "embedding"), "queries")
    sample = firsts.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = spark.sparkContext.broadcast(fit(np.array(sample.tolist(), np.float64)))
    n = firsts.count()
    blocks = max(math.ceil(n / BLOCK), min(SPREAD, math.ceil(n * SPREAD / BLOCK)))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                q = quantiser.value
                yield part.assign(code=[c.tobytes() for c in q.pack(q.encode(np.stack(part["embedding"].tolist())))])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by block, vectors before queries."""
        q, block, ready, waiting = quantiser.value, None, None, []
        for part in parts:
            out = []
            for (b, asks), own in part.groupby(["block", "asks"], sort=True):
                if b != block:
                    block, ready, waiting = b, None, []
                if not asks:
                    waiting.append(own)
                    continue
                if ready is None:
                    if not waiting:
                        continue
                    every_row = pd.concat(waiting)
                    waiting = []
                    ids, nodes = (every_row[c].to_numpy(np.int64) for c in ("vec_id", "node"))
                    codes = np.frombuffer(b"".join(every_row["code"]), np.uint8).reshape(len(ids), -1).T.copy()
                    ready = ids, nodes, codes, np.stack(every_row["embedding"].tolist()).astype(np.float64)
                ids, nodes, codes, exact = ready
                x = np.stack(own["embedding"].tolist()).astype(np.float64)
                for begin in range(0, len(x), 256):
                    for k, table in enumerate(q.tables(x[begin : begin + 256]), begin):
                        guess = table[0].take(codes[0])
                        for t, c in zip(table[1:], codes[1:]):
                            guess += t.take(c)
                        at = best(guess, ids, RERANK)
                        score = (exact[at] * x[k]).sum(axis=1)
                        first = best(score, ids[at], top + 1)
                        out.append((int(own["node"].iloc[k]), b, [{"down": float(-score[i]), "vec_id": int(ids[at[i]]), "node": int(nodes[at[i]])} for i in first]))
            if out:
                yield pd.DataFrame(out, columns=["first", "block", "near"])

    near = "array<struct<down: double, vec_id: long, node: long>>"
    kind = firsts.schema["embedding"].dataType.simpleString()  # products are of the vectors as given, floats or doubles
    indexed = small_batches(firsts).mapInPandas(index, f"vec_id long, embedding {kind}, node long, code binary")
    indexed = indexed.withColumns({"block": F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"), "asks": F.lit(False)})
    asked = queries.select(F.col("first").alias("node"), "embedding").dropDuplicates(["node"]).withColumn("vec_id", F.lit(0).cast("long"))
    asked = asked.withColumns({"code": F.lit(None).cast("binary"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(True)})
    found = indexed.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks", "node").mapInPandas(scan, f"first long, block int, near {near}")
    while True:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, top + 1)
        found = found.groupBy("first", F.floor(F.col("block") / FAN).cast("int").alias("block")).agg(merged.alias("near"))
        blocks = math.ceil(blocks / FAN)
        if blocks <= 1:
            break
    one = found.select("first", F.explode("near").alias("n")).select("first", F.col("n.node").alias("node"), (-F.col("n.down")).alias("score"))
    others = kept.select("vec_id", "embedding").join(firsts.select("embedding", "node"), "embedding").select("vec_id", "node")
    by_score = Window.partitionBy("first").orderBy(F.desc("score"), "vec_id")
    spread = one.join(others, "node").withColumn("k", F.row_number().over(by_score)).where(F.col("k") <= top + 1).select("first", "vec_id", "node", "score")
    paired = queries.select("query_id", "first").join(spread, "first").where("query_id <> vec_id or first <> node")
    ranked = paired.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "first").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
