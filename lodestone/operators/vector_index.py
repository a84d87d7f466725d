"""A vector index in tables: k-means cells in two levels, a share of them probed, exact distances in the probed cells.

The vectors of a bounded sample give at most ROOTS root cells; inside each root, a bounded sample of its own vectors gives leaf cells of about
`leaf` vectors. Both are tables beside the vectors, which are stored by root and leaf. New vectors go into the cells that are there, without
another fit. A query ranks the roots, and in the roots that are near enough the leaves, both up to the share `probe`; its distances to the
vectors of those leaves are exact (cosine, double precision). `probe` 1 reads every cell: the exact way. `calibrate` measures on a sample of
the index's own vectors which share a wanted recall takes.

What meets in one task is a block: leaves of one root of about BLOCK vectors together, or a part of a leaf that has more (copies of one vector
fall into one leaf, so a leaf may be any size), and a slice of about ASKS queries. A query is sent once to each block it probes, not once to each leaf;
what a task makes of its queries leaves it in pieces of about PIECE numbers.

Defined cases: vectors that are null, empty, zero, hold a null or non-finite component, or differ in length from those the index was built on
take no part; rows with a null id take no part; equal vectors tie and go by the smaller id; an index of an empty table has no cells, and
vectors put into it are an error; a query finds at most k, fewer where fewer are probed; a point whose id is the query's is left out.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import materialised

from .tables import top_k

ROOTS, SAMPLE, ROUNDS, BLOCK, ASKS, PIECE = 1024, 65_536, 12, 16_384, 4096, 1 << 20


def unit(df: DataFrame, key: str, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, v (of length 1) and the columns of `keep`, of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = F.col(key).isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (norm > 0), F.lit(False))
    return df.where(fine).select(F.col(key).alias("id"), F.transform(v, lambda x: x / norm).alias("v"), *keep)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """At most k directions by Lloyd's rounds on unit vectors; seeds are spread over x as given, cells that run empty go."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1)
        c = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    return c


def _first(df: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """n rows (of each group) by the hash of id."""
    order = (F.xxhash64("id"), F.col("id"))
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _far(mine: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return 1 - mine @ cells.T


class VectorIndex:
    """An index in the folder `path`: its cells, and the vectors in them."""

    def __init__(self, spark: SparkSession, path: str, roots: np.ndarray, told: dict):
        self.spark, self.path, self.roots, self.told = spark, path, roots, told

    @staticmethod
    def build(points: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), leaf: int = 500) -> VectorIndex:
        """Fit the cells on `points` and put them in. keep: columns that searches may filter by."""
        spark = points.sparkSession
        given = materialised(unit(points, key, vector, keep), "vectors")
        n = given.count()
        sample = _first(given.select("id", "v"), SAMPLE).toPandas()["v"].tolist()
        dims = max({len(v) for v in sample}, key=lambda d: (sum(len(v) == d for v in sample), -d)) if sample else 0
        x = np.array([v for v in sample if len(v) == dims]).reshape(-1, dims or 1)
        roots = _means(x, min(ROOTS, math.ceil(math.sqrt(n / leaf)))) if len(x) else x
        told = {"dims": dims, "leaf": leaf, "key": given.schema["id"].dataType.simpleString(), "keep": list(keep), "roots": roots.tolist()}
        index = VectorIndex(spark, path.rstrip("/"), roots, told)
        spark.createDataFrame([(json.dumps(told),)], "told string").write.parquet(f"{index.path}/told")
        rooted = index._rooted(given)
        size = rooted.groupBy("root").agg(F.ceil(F.count("*") / leaf).cast("int").alias("leaves"))
        own = _first(rooted.select("root", "id", "v"), SAMPLE // 4, ("root",)).join(size, "root")

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            c = _means(np.array(rows["v"].tolist()), int(rows["leaves"].iloc[0]))
            return pd.DataFrame({"root": rows["root"].iloc[0], "leaf": np.arange(len(c)), "centre": c.tolist()})

        own.groupBy("root").applyInPandas(fit, "root int, leaf int, centre array<double>").write.parquet(f"{index.path}/leaves")
        index._put(rooted)
        return index

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        told = json.loads(spark.read.parquet(f"{path.rstrip('/')}/told").first()["told"])
        return VectorIndex(spark, path.rstrip("/"), np.array(told["roots"]).reshape(-1, told["dims"] or 1), told)

    def insert(self, points: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Put new vectors into the cells that are there. Ids are not looked up: an id put in twice is there twice."""
        if not len(self.roots):
            raise ValueError("an index of an empty table has no cells; build it again")
        self._put(self._rooted(unit(points, key, vector, tuple(self.told["keep"]))))

    def leaves(self) -> DataFrame:
        """root, leaf, centre."""
        return self.spark.read.schema("root int, leaf int, centre array<double>").parquet(f"{self.path}/leaves")

    def vectors(self) -> DataFrame:
        """root, leaf, id, v and the kept columns of every vector in the index."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def _rooted(self, rows: DataFrame) -> DataFrame:
        roots, dims = self.spark.sparkContext.broadcast(self.roots), self.told["dims"]  # ROOTS vectors at most

        def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                part = part[part["v"].map(len) == dims] if dims else part.iloc[:0]
                if len(part):
                    yield part.assign(root=_far(np.array(part["v"].tolist()), roots.value).argmin(axis=1))

        return rows.mapInPandas(nearest, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", root int")

    def _put(self, rooted: DataFrame) -> None:
        """Give rooted vectors their leaf and append them. The rows of a root are dealt into salts, each of which gets the root's leaves."""
        fields = [f for f in rooted.schema if f.name != "root"]
        names = [f.name for f in fields]
        salts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rooted.withColumns({"_salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"), "leaf": F.lit(-1)})
        cells = self.leaves().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("centre", "v")
        cells = cells.select(*[F.col(n) if n == "v" else F.lit(None).cast(f.dataType).alias(n) for n, f in zip(names, fields)], "root", "_salt", "leaf")

        def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows by root and salt, the root's leaves before its vectors."""
            root, leaves = None, {}
            for part in parts:
                for (r, is_row), own in part.groupby(["root", part["leaf"] < 0], sort=True):
                    if r != root:
                        root, leaves = r, {}
                    if not is_row:  # once a salt of the partition
                        leaves |= dict(zip(own["leaf"], own["v"]))
                    elif leaves:
                        at = _far(np.array(own["v"].tolist()), np.array(list(leaves.values()))).argmin(axis=1)
                        yield own.assign(leaf=np.array(list(leaves))[at])[[*names, "root", "leaf"]]

        met = rows.select(*names, "root", "_salt", "leaf").unionByName(cells).repartition("_salt").sortWithinPartitions("root", F.col("leaf") < 0)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        met.mapInPandas(assign, f"{kinds}, root int, leaf int").write.mode("append").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int, probe: float = 0.3, qid: str = "query_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
        """(qid, id, rank, distance): the k nearest of the vectors in the probed cells, ties to the smaller id. where: on the kept columns."""
        return top_k(self._hits(queries, k, probe, qid, vector, where).drop("need"), [qid], [F.col("distance"), F.col("id")], k)

    def calibrate(self, k: int, recall: float = 0.9, queries: int = 256) -> float:
        """The least share that finds `recall` of the k nearest of a sample of the index's own vectors, by their hash."""
        asked = _first(self.vectors().select("id", "v"), queries).select(F.col("id").alias("query_id"), F.col("v").alias("embedding"))
        hits = self._hits(asked, k, 1.0, "query_id", "embedding", None)
        near = top_k(hits, ["query_id"], [F.col("distance"), F.col("id")], k)
        found = np.sort(near.select("need").toPandas()["need"].to_numpy())  # queries times k numbers at most
        return float(found[min(len(found) - 1, math.ceil(recall * len(found)))]) if len(found) else 1.0

    def _hits(self, queries: DataFrame, k: int, probe: float, qid: str, vector: str, where: Column | None) -> DataFrame:
        """qid, id, distance, need: the k nearest of each block, and the share at which the cell of each is probed."""
        roots, dims, leaf = self.spark.sparkContext.broadcast(self.roots), self.told["dims"], self.told["leaf"]
        kind, own = queries.schema[qid].dataType.simpleString(), self.told["key"]
        few = max(1, BLOCK // leaf)
        points = self.vectors()
        points = (points.where(where) if where is not None else points).select("root", (F.col("leaf") / few).cast("int").alias("block"), "leaf", "id", "v")
        size = points.groupBy("root", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))

        def rank_roots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                every = part[part["v"].map(len) == dims] if dims else part.iloc[:0]
                step = max(1, PIECE // max(1, len(roots.value) * (dims + 2)))
                for part in (every.iloc[i : i + step] for i in range(0, len(every), step)):
                    far = _far(np.array(part["v"].tolist()), roots.value)
                    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1) / far.shape[1]
                    row, root = np.nonzero(place < probe)
                    yield part.iloc[row].assign(root=root, need=place[row, root])

        def rank_leaves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows by root, its leaves before the queries that reach it: a row a query and block, with the leaves to read there."""
            root, leaves, names = None, {}, ["id", "v", "root", "block", "leaves", "needs"]
            for part in parts:
                out, held = [], 0
                for (r, asks), mine in part.groupby(["root", part["leaf"] < 0], sort=True):
                    if r != root:
                        root, leaves = r, {}
                    if not asks:
                        leaves |= dict(zip(mine["leaf"], mine["v"]))
                    elif leaves:
                        cells, at = np.array(list(leaves.values())), np.array(list(leaves))
                        for i, v, need in zip(mine["id"], mine["v"], mine["need"]):
                            place = np.argsort(np.argsort(_far(v, cells), kind="stable")) / len(at)
                            read = place < probe
                            for b in np.unique(at[read] // few):
                                mark = read & (at // few == b)
                                out.append((i, v, r, b, at[mark].tolist(), np.maximum(place[mark], need).tolist()))
                                held += len(v) + 2 * len(out[-1][4])
                            if held >= PIECE:
                                yield pd.DataFrame(out, columns=names)
                                out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

        q = unit(queries, qid, vector).mapInPandas(rank_roots, f"id {kind}, v array<double>, root int, need double").withColumn("leaf", F.lit(-1))
        salts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        cells = self.leaves().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        cells = cells.select(F.lit(None).cast(kind).alias("id"), F.col("centre").alias("v"), "root", F.lit(0.0).alias("need"), "leaf", "_salt")
        met = q.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).unionByName(cells)
        met = met.repartition("_salt").sortWithinPartitions("root", F.col("leaf") < 0).drop("_salt")
        asked = met.mapInPandas(rank_leaves, f"id {kind}, v array<double>, root int, block int, leaves array<int>, needs array<double>")
        asked = asked.join(size, ["root", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        placed = points.join(size, ["root", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        slices = max(1, math.ceil(queries.count() / ASKS))  # a block comes once a slice: its vectors are fewer than what the queries of a slice bring
        asked = asked.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).cast("int"))
        placed = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

        def meet(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(block):
                block = block.sort_values("leaf", kind="stable")
                ids, y, cell = block["id"].to_numpy(), np.array(block["v"].tolist()), block["leaf"].to_numpy()
                for i, v, leaves, needs in zip(asks["id"], asks["v"], asks["leaves"], asks["needs"]):
                    low, high = np.searchsorted(cell, leaves), np.searchsorted(cell, leaves, side="right")
                    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
                    need = np.repeat(needs, high - low)
                    other = ids[at] != i
                    at, need = at[other], need[other]
                    far = 1 - y[at] @ v
                    near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
                    near = near[np.lexsort((ids[at[near]], far[near]))][:k]
                    out += zip([i] * len(near), ids[at[near]], far[near], need[near])
            return pd.DataFrame(out, columns=[qid, "id", "distance", "need"])

        by = ("root", "block", "part", "slice")
        return asked.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(meet, f"{qid} {kind}, id {own}, distance double, need double")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for an index, beside the tables in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or materialised(spark.range(0), "root")._lodestone_path.rsplit("/", 1)[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
