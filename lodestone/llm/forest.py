r"""MinHash near-duplicates by an LSH forest, confirmed on full sets of word shingles.

A signature has LEVELS * TREES minhashes. Each tree is the table of all distinct shingle sets sorted by the signature as read from
its own position on, so one signature gives several sorted orders, and rows with a common prefix stand side by side. The orders are dealt by
ranges of the whole key, so a region that a third of all rows share is cut at deeper levels and no task holds a group.

A region is a run of rows that share LEVELS minhashes of a tree, in chunks of CHUNK rows or BULK shingles at most, cut along the order. Inside a
chunk a row's candidates come by their longest common prefix with it, so from the deepest level that the region offers upwards, and rows that
confirmed links have joined already are passed over: where rows are dense, the nearest at great depth settle it; where they are
sparse, the search goes up to the region's first level. Every pair of a region is met, or is joined already, so nothing is capped. Chunks of one region
first stand alone; if their links leave a region of several chunks in more than one component, pairs of its chunks are tried across components.
A pair that shares regions in several trees is met in the first of them only.

Pairs are first held against the size bound, which is exact, and the agreement of signatures (LEAST of 72; a pair of similarity 0.8 has
fewer with a probability of 2e-8); only rows with such a partner get their full sets from their texts, which then confirm. A pair of
similarity 0.8 shares no region of any tree with a probability of (1 - 0.8^3)^24 = 3e-8; those are all the losses. Shingles are 64-bit
hashes, sets are told apart by 128-bit digests of all their shingles.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing, each is its own component; fewer words than a
shingle are one shingle, the whole sequence; equal sets are one node, linked by definition; rows with a null doc_id keep a row and take part,
but never name a component (null if no other member has an id); repeated rows are kept; an empty table gives an empty
table; other columns are ignored. Texts are held whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import small_batches, whole_text, written

SIZE, PERCENT = 4, 80
TREES, LEVELS, DEEPER = 24, 3, 8
HASHES = TREES * LEVELS
LEAST, CHUNK, BULK = 36, 1024, 4_000_000
_RNG = np.random.default_rng(20)
_FACTORS, _SHIFTS = _RNG.integers(0, 2**64, (2, HASHES), np.uint64, endpoint=False)
_FACTORS |= np.uint64(1)
#: What word hashes are multiplied by, and what is added for each width under a shingle's.
_MIX, _FEW = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased."""
    words = text.encode().lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    few = len(w) < size
    width = len(w) if few else size
    x = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        x = x * _MIX + w[k : k + len(x)]
    return np.unique(x + np.uint64(_FEW * width % 2**64) if few else x)


def signature(sets: np.ndarray) -> np.ndarray:
    """HASHES minhashes (32 bits each) of a set that isn't empty."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(sets), 1024):
        out = np.minimum(out, (sets[k : k + 1024, None] * _FACTORS + _SHIFTS).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), digest of the set, signature; of a text without words the last two are null. docs: doc_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, digests, signatures = [], [], []
            for text in b["text"]:
                s = shingles(text)
                n.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": n, "digest": digests, "signature": signatures})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", whole_text().alias("text"))).mapInPandas(run, f"doc_id {kind}, n long, digest binary, signature binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _order(m: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The first LEVELS minhashes of a tree's order as one 64-bit key, and a byte of each of the DEEPER next."""
    key = np.zeros(len(m), np.uint64)
    for k in range(LEVELS):
        key = (key ^ m[:, tree * LEVELS + k]) * _MIX
        key ^= key >> np.uint64(29)
    deep = np.zeros(len(m), np.uint64)
    for k in range(DEEPER):
        deep = deep << np.uint64(8) | (m[:, (tree * LEVELS + LEVELS + k) % HASHES] & np.uint32(255)).astype(np.uint64)
    return key.view(np.int64), deep.view(np.int64)


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for low in range(0, len(b), 4096):
            m, nodes, n = _matrix(b["signature"].iloc[low : low + 4096]), *(b[c].to_numpy(np.int64)[low : low + 4096] for c in ("node", "n"))
            for tree in range(TREES):
                key, deep = _order(m, tree)
                yield pd.DataFrame({"tree": tree, "key": key, "deep": deep, "node": nodes, "n": n})


def _chunked(rows: int, bulk: int):
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a sorted partition that share a region with the row before or after, and the partition's first and last row, with their chunk."""
        part, last, at = TaskContext.get().partitionId() << 32, None, (None, 0, 0, 0)  # region, chunk, rows and shingles in it
        for b in batches:
            if not len(b):
                continue
            chunk = []
            for tree, key, n in zip(b["tree"].tolist(), b["key"].tolist(), b["n"].tolist()):
                region, c, k, size = at
                if region != (tree, key):
                    c, k, size = 0, 0, 0
                elif k >= rows or size + n > bulk:
                    c, k, size = c + 1, 0, 0
                at = (tree, key), c, k + 1, size + n
                chunk.append(part + c)
            b = b[["tree", "key", "deep", "node"]].assign(chunk=np.array(chunk, np.int64))
            first = last is None
            b = b if first else pd.concat([last[0], b], ignore_index=True)
            same = ((b["tree"].to_numpy()[1:] == b["tree"].to_numpy()[:-1]) & (b["key"].to_numpy()[1:] == b["key"].to_numpy()[:-1])).tolist()
            keep = np.array([first or last[1], *same]) | np.array([*same, False])
            last = b.iloc[-1:], bool(keep[-1])
            if keep[:-1].any():
                yield b.iloc[:-1][keep[:-1]]
        if last is not None:
            yield last[0]

    return chunks


def orders(nodes: DataFrame, chunk: int = CHUNK, bulk: int = BULK) -> DataFrame:
    """tree, key, deep, node, chunk of the rows that share a region with a neighbour (and of the ends of ranges)."""
    grown = nodes.select("node", "n", "signature").mapInPandas(_grow, "tree int, key long, deep long, node long, n long")
    by = ("tree", "key", "deep", "node")
    return grown.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(_chunked(chunk, bulk), "tree int, key long, deep long, node long, chunk long")


UNIT = ["tree", "key", "a", "b"]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of a sorted partition in frames of whole units, with the places at which units begin and the end."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if len(b):
            unit = b[UNIT].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(axis=1)]))
            held = b.iloc[starts[-1] :]
            if len(starts) > 1:
                yield b.iloc[: starts[-1]], starts
    if held is not None:
        yield held, np.array([0, len(held)])


def _possible(m: np.ndarray, n: np.ndarray, tree: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j may be linked by their sizes and signatures, and this is the first tree in which they share a region."""
    same = m[i] == m[j]
    first = same.reshape(-1, TREES, LEVELS).all(axis=2).argmax(axis=1)
    return (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (np.count_nonzero(same, axis=1) >= LEAST) & (first == tree[i])


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that have a possible partner in their unit."""
    for b, starts in _units(batches):
        m, (n, tree, root, chunk) = _matrix(b["signature"]), (b[c].to_numpy(np.int64) for c in ("n", "tree", "root", "chunk"))
        across, keep = (b["a"] != b["b"]).to_numpy(), np.zeros(len(b), bool)
        low, size = starts[:-1], np.diff(starts)
        two = low[size == 2]
        two = two[(root[two] != root[two + 1]) & (~across[two] | (chunk[two] != chunk[two + 1]))]
        two = two[_possible(m, n, tree, two, two + 1)] if len(two) else two
        keep[two] = keep[two + 1] = True
        for begin, k in zip(low[size > 2].tolist(), size[size > 2].tolist()):
            for i in range(begin, begin + k - 1):
                j = np.arange(i + 1, begin + k)
                j = j[(root[j] != root[i]) & (not across[i] or chunk[j] != chunk[i])]
                if len(j) and len(j := j[_possible(m, n, tree, i, j)]):
                    keep[i] = keep[j] = True
        if keep.any():
            yield b[keep]


def _shared(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The size of each set's intersection with own."""
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat(own[at] == every, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Confirmed links that join the rows of each unit as all its links do. Rows of a unit come in the tree's order."""
    for b, starts in _units(batches):
        m, (n, tree, node, chunk) = _matrix(b["signature"]), (b[c].to_numpy(np.int64) for c in ("n", "tree", "node", "chunk"))
        root, across = b["root"].to_numpy(np.int64).copy(), (b["a"] != b["b"]).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in b["shingles"]]
        links = []
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            for i in range(begin, end - 1):
                at, step = i + 1, 8
                while at < end:  # from the longest common prefix on; what is joined by then is passed over
                    j = np.arange(at, min(end, at + step))
                    at, step = at + step, 4 * step
                    j = j[(root[j] != root[i]) & (not across[i] or chunk[j] != chunk[i])]
                    if not len(j) or not len(j := j[_possible(m, n, tree, i, j)]):
                        continue
                    both = _shared(sets[i], [sets[x] for x in j])
                    for x in j[100 * both >= PERCENT * (n[i] + n[j] - both)].tolist():
                        if root[x] != root[i]:
                            links.append((node[i], node[x]))
                            own = root[begin:end]
                            own[own == root[x]] = root[i]
        if links:
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def confirmed(units: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v), links whose components are those of all links within the units: tree, key, a, b, chunk, deep, node, root."""
    columns = [*UNIT, "chunk", "deep", "node", "root", "n", "signature"]
    kinds = "tree int, key long, a long, b long, chunk long, deep long, node long, root long, n long, signature binary"
    met = units.join(nodes.select("node", "n", "signature"), "node").select(*columns).repartition(*UNIT).sortWithinPartitions(*UNIT)
    paired = written(met.mapInPandas(_paired, kinds), "paired")
    wanted = written(nodes.select("node", "digest", "least").join(paired.select("node").distinct(), "node", "left_semi"), "wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"digest": [_digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    ids = wanted.select(F.col("least").alias("_least")).distinct()
    texts = docs.select("doc_id", whole_text().alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = small_batches(texts.select("text")).mapInPandas(run, "digest binary, shingles binary")
    sets = written(sets.join(wanted.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "shingles"), "sets")
    full = paired.join(sets, "node").select(*columns, "shingles").repartition(*UNIT).sortWithinPartitions(*UNIT, "deep", "node")
    return written(full.mapInPandas(_linked, "u long, v long"), "links")


def across(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """Units of two chunks of each region that has several and more than one component. regions: tree, key, deep, node, chunk; roots: node, root."""
    several = regions.groupBy("tree", "key", "chunk").agg(F.lit(1).alias("_one")).groupBy("tree", "key").agg(F.collect_list("chunk").alias("chunks"))
    several = written(several.where(F.size("chunks") > 1), "several")  # no longer than rows of a region / CHUNK, and ranges
    rows = regions.join(several, ["tree", "key"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows, "wide")
    mixed = rows.groupBy("tree", "key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("tree", "key")
    rows = rows.join(mixed, ["tree", "key"]).withColumn("other", F.explode("chunks")).where("other <> chunk")
    return rows.select("tree", "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "deep", "node", "root")


def near_duplicates(docs: DataFrame, text: str = "text", chunk: int = CHUNK, bulk: int = BULK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, the own included) of every row."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    marked = written(signed(docs), "signed")
    nodes = marked.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    regions = written(orders(nodes, chunk, bulk), "regions")
    alone = regions.select("tree", "key", F.col("chunk").alias("a"), F.col("chunk").alias("b"), "chunk", "deep", "node", F.col("node").alias("root"))
    links = confirmed(alone, nodes, docs)
    roots = written(components(links), "roots")
    wide = written(across(regions, roots), "units")
    if not wide.isEmpty():
        roots = components(links.unionByName(confirmed(wide, nodes, docs)))
    named = nodes.select("digest", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("digest", "component_id", F.lit(True).alias("_linked"))
    out = marked.select("doc_id", "n", "digest").join(classes, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the document is the first of its component (null without an id)."""
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))
