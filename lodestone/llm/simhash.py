"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Each segment, zero-padded to 23 bits, is decoded
with the perfect binary Golay code [23,12,7]: the word itself and every word one flip away fall to the index of
their nearest codeword, which gives one or six keys of 12 bits. Two segments that differ in at most two bits have
a word between them that is at most one flip from each, so they share a key. Fingerprints that differ in at most
four bits have at most two differing bits in two of the three segments at least, so they share a key of some pair
of segments; rows meet by that pair key and every meeting is verified by the true distance.

Meetings inside a bucket emit a spanning forest of the verified links, never all pairs. A bucket larger than CHUNK
is cut: each chunk is linked in itself, and every pair of chunks is then a unit of work of its own.

Defined cases: null and wordless texts have fingerprint 0 and are linked like any other; texts with fewer words
than a shingle have one shingle, the whole sequence; equal fingerprints are one node; rows with a null doc_id keep
a row and take part, but never name a component (null if no other member has an id); repeated rows are kept;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .graph import components
from .shared import free, small_batches, whole_text, written

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (lowest bit, bits) of each segment, and the pairs of segments that are joined.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
CHUNK = 2048
#: The generator polynomial of the [23,12,7] code.
GOLAY = 0b110001110101


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of word shingles, A-Z lower-cased, as an unsigned integer."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1)[: n - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with `out`, the fingerprint of each whole text as a signed long."""

    @pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64), dtype="int64")

    return small_batches(docs).withColumn(out, run.asNondeterministic()(whole_text(text)))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits, and the error pattern (at most 3 bits) of each of the 2,048 syndromes."""

    def rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GOLAY << (k - 11)
        return word

    high = np.array([rest(x << 11) for x in range(4096)], np.int64)
    single = [rest(1 << k) for k in range(23)]
    errors = np.zeros(2048, np.int64)
    for a in range(23):
        errors[single[a]] = 1 << a
        for b in range(a):
            errors[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return high, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    high, errors = _tables()
    return (words ^ errors[high[words >> 11] ^ (words & 2047)]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of the word and its one-flip neighbours, and which of them are filled."""
    ball = np.sort(decode(np.column_stack([words, *(words ^ (1 << k) for k in range(bits))])), axis=1)
    new = np.ones(ball.shape, bool)
    new[:, 1:] = ball[:, 1:] != ball[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    keys, filled = np.zeros((len(words), 6), np.int64), np.zeros((len(words), 6), bool)
    row = np.broadcast_to(np.arange(len(words))[:, None], ball.shape)
    keys[row[new], place[new]] = ball[new]
    filled[row[new], place[new]] = True
    return keys, filled


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, key) of every pair key."""
    u = fps.view(np.uint64)
    each = [segment_keys((u >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64), bits) for low, bits in SEGMENTS]
    at, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        (ka, fa), (kb, fb) = each[a], each[b]
        both = fa[:, :, None] & fb[:, None, :]
        value = p << 24 | ka[:, :, None] << 12 | kb[:, None, :]
        at.append(np.nonzero(both)[0])
        keys.append(value[both])
    return np.concatenate(at), np.concatenate(keys)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of signed numbers it would count the bits of the magnitude


def _forest(a: np.ndarray, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among a, or of those between a and b."""
    both = a if b is None else np.concatenate([a, b])
    near = _near(a[:, None], (a if b is None else b)[None, :])
    left = np.ones(len(both), bool)
    links = []
    for root in range(len(both)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            if b is None:
                to = np.nonzero(near[i] & left)[0]
            elif i < len(a):
                to = np.nonzero(near[i] & left[len(a) :])[0] + len(a)
            else:
                to = np.nonzero(near[:, i - len(a)] & left[: len(a)])[0]
            left[to] = False
            stack += to.tolist()
            links += [(both[i], both[j]) for j in to]
    return links


def _rows(links: list, spare: tuple[list, list, list]) -> pd.DataFrame:
    """Links (u, v) and, with a key and chunk, rows of oversized buckets that still have to meet."""
    links = list(dict.fromkeys((min(x), max(x)) for x in links))
    keys, chunks, fps = spare
    return pd.DataFrame(
        {
            "u": np.array([x for x, _ in links] + fps, np.int64),
            "v": np.array([y for _, y in links] + fps, np.int64),
            "key": np.array([-1] * len(links) + keys, np.int64),
            "chunk": np.array([-1] * len(links) + chunks, np.int64),
        }
    )


def _scan(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in a sorted partition: links of each bucket, chunk by chunk."""
    key, held, chunk = None, np.empty(0, np.int64), 0

    def close(links, spare, last):
        """Link what is held; put it aside too if its bucket has more than one chunk."""
        if len(held) > 1:
            links += _forest(held)
        if chunk or not last:
            spare[0].extend([key] * len(held))
            spare[1].extend([chunk] * len(held))
            spare[2].extend(held.tolist())

    for part in parts:
        k, fp = part["key"].to_numpy(), part["fp"].to_numpy()
        links, spare = [], ([], [], [])
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        ends = np.append(edge[1:], len(k))
        # buckets of one or two rows inside the batch are handled at once; the first and last may go on in other batches
        rows = ends - edge
        two = np.flatnonzero(rows == 2)
        two = two[(two > 0) & (two < len(edge) - 1)]
        hit = two[_near(fp[edge[two]], fp[edge[two] + 1])]
        links += list(zip(fp[edge[hit]].tolist(), fp[edge[hit] + 1].tolist()))
        more = np.flatnonzero(rows > 2)
        for r in sorted({*more.tolist(), *([0, len(edge) - 1] if len(edge) else [])}):
            a, b = int(edge[r]), int(ends[r])
            if key is not None and k[a] != key:
                close(links, spare, True)
                key, held, chunk = None, np.empty(0, np.int64), 0
            key = int(k[a])
            held = np.concatenate([held, fp[a:b]])
            while len(held) > size:
                rest = held[size:]
                held = held[:size]
                close(links, spare, False)
                held, chunk = rest, chunk + 1
        if links or spare[0]:
            yield _rows(links, spare)
    if key is not None:
        links, spare = [], ([], [], [])
        close(links, spare, True)
        yield _rows(links, spare)


def _meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the two chunks of each (key, a, b) run of a sorted partition."""
    run, left, right = None, [], []

    def close():
        if run is None or not left or not right:
            return None
        links = _forest(np.array(left, np.int64), np.array(right, np.int64))
        return pd.DataFrame(dict.fromkeys((min(x), max(x)) for x in links).keys(), columns=["u", "v"], dtype="int64")

    for part in parts:
        for key, a, b, chunk, fp in part[["key", "a", "b", "chunk", "fp"]].itertuples(index=False):
            if (key, a, b) != run:
                if (out := close()) is not None:
                    yield out
                run, left, right = (key, a, b), [], []
            (left if chunk == a else right).append(fp)
    if (out := close()) is not None:
        yield out


def links(fps: DataFrame, size: int = CHUNK) -> DataFrame:
    """Links (u, v) among the distinct longs of fps.fp whose components are those of all links of 4 bits or fewer."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _scan(parts, size)

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = part["fp"].to_numpy(np.int64)
            for k in range(0, len(fp), 4096):
                at, keys = pair_keys(fp[k : k + 4096])
                yield pd.DataFrame({"key": keys, "fp": fp[k : k + 4096][at]})

    even = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = even.mapInPandas(keyed, "key long, fp long")
    found = written(
        rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(scan, "u long, v long, key long, chunk long"), "met"
    )
    near = found.where("key < 0").select("u", "v")
    spare = found.where("key >= 0").select("key", "chunk", F.col("u").alias("fp"))
    chunks = spare.groupBy("key").agg(F.max("chunk").alias("most"))
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), "most"), lambda c: c != F.col("chunk")))
    met = (
        spare.join(chunks, "key")
        .select("key", "chunk", "fp", other.alias("other"))
        .select("key", "chunk", "fp", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
        .repartition("key", "a", "b")
        .sortWithinPartitions("key", "a", "b", "chunk", "fp")
        .mapInPandas(_meet, "u long, v long")
    )
    return near.unionByName(met).distinct()


def _rooted(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marked (fp and more) with root, a fingerprint that names the component; and (root, component_id), its least doc_id."""
    roots = components(links(marked))
    rooted = marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted, written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach, the own included) of every row."""
    marked = written(fingerprints(docs.select("doc_id", F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    rooted, least = _rooted(marked)
    return rooted.join(least, "root").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group: that of the least doc_id, null last, and of several rows of that id the one whose columns have the least hash.

    Rows are told apart by doc_id and a hash of all their columns, so texts that are no duplicates stay, also under one doc_id or
    without one; of rows that are equal in every column one stays.
    """
    row = free("_content", docs)
    told = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    docs = docs.withColumn(row, F.xxhash64(*told))
    marked = fingerprints(docs.select("doc_id", F.col(row).alias("content"), F.col(f"`{text}`").alias("text"))).select("doc_id", "content", "fp")
    rooted, least = _rooted(written(marked, "fingerprints"))
    first = rooted.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("content").alias("_row"))
    first = written(first.select(F.col("component_id").alias("_id"), "_row").distinct(), "kept")
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_row")), "left_semi")
    return kept.dropDuplicates(["doc_id", row]).drop(row)
