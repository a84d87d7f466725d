"""Document fingerprints by locally consistent parsing.

A text starts as its code points. On each level runs of one name become one name, then deterministic coin tossing labels
every name by the lowest bit in which it differs from its left neighbour; three rounds leave fewer than eight labels, no two
neighbours alike. Local maxima of the labels start the phrases, and a phrase's content gives its name on the next
level. Where a phrase ends depends only on a bounded neighbourhood, so equal substrings get equal interior
phrases at any offset. A fingerprint holds the least hashes of the names of level 2 (phrases of about 6 code points)
and of level 3 (about 15), repeats counted; likeness is the estimated share of common names, on level 3 where both texts have
enough of them, else on level 2.

Defined cases: null text counts as empty; two empty texts have likeness 1, an empty and another 0; texts of any length are
parsed whole; equal texts have equal fingerprints. The next document is the one of the next greater doc_id (equal doc_ids by
text), the first for the last; null doc_ids come first, by a hash of their texts (as ids from -2^63 up to -2^62), so that many of
them are ranges like others; a lone document is its own next. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, whole_text

#: Hashes kept of level 2 and level 3, the fewest phrases of level 3 that decide, and code points parsed at once.
KEEP, ENOUGH, AT_ONCE = (16, 64), 8, 1 << 20

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_WEIGHTS = np.multiply.accumulate(np.full(1 << 8, np.uint64(0x9E3779B97F4A7C15)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _toss(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which x differs from its left neighbour, plus that bit of x."""
    diff = np.empty_like(x)
    diff[1:] = x[1:] ^ x[:-1]
    diff[head] = 1
    low = diff & (~diff + x.dtype.type(1))
    place = np.bitwise_count(low - x.dtype.type(1))
    return place * np.uint8(2) + ((x & low) != 0)


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of all texts in a row and where each text starts -> the same of their phrases. No text is empty."""
    n = len(names)
    new = np.ones(n, bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) < n:
        long = np.diff(np.append(at, n))
        names = names[at]
        run = long > 1
        names[run] = _mixed(names[run] + long[run].astype(np.uint64) * _WEIGHTS[7])
        first = np.searchsorted(at, first)
        n = len(names)
    labels = _toss(names, first)
    for _ in range(2):
        labels = _toss(labels, first)
    start = np.zeros(n, bool)
    start[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(first[1:], n) - 1
    start[last] = False
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    offset = np.arange(n) - np.repeat(at, size)
    out = np.add.reduceat(names * _WEIGHTS[offset & 255], at)
    return _mixed(out + size.astype(np.uint64)), np.searchsorted(at, first)


def _least(names: np.ndarray, first: np.ndarray, keep: int) -> list[np.ndarray]:
    """The `keep` least distinct 32-bit hashes of each text's names, ascending; the n-th occurrence of a name counts as its own."""
    owner = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(names)))) << np.uint64(32)
    key = np.sort(owner | _mixed(names + _WEIGHTS[3]) >> np.uint64(32))
    place = np.arange(len(key))
    new = np.append(True, key[1:] != key[:-1])
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    more = np.flatnonzero(again)
    if len(more):
        apart = _mixed((key[more] & np.uint64(0xFFFFFFFF)) + again[more].astype(np.uint64) * _WEIGHTS[5]) >> np.uint64(32)
        key[more] = key[more] >> np.uint64(32) << np.uint64(32) | apart
        key = np.unique(key)
    edge = np.searchsorted(key, np.arange(len(first) + 1, dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    return [low[a : min(b, a + keep)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


Sketch = tuple[np.ndarray, np.ndarray]
_NOTHING = np.empty(0, np.uint32)


def sketches(points: list[np.ndarray]) -> list[Sketch]:
    """Least hashes of level 2 and of level 3 of each array of code points."""
    out: list[Sketch] = [(_NOTHING, _NOTHING)] * len(points)
    begin = 0
    while begin < len(points):
        total, end = 0, begin
        while end < len(points) and (end == begin or total + len(points[end]) <= AT_ONCE):
            total += len(points[end])
            end += 1
        full = [k for k in range(begin, end) if len(points[k])]
        if full:
            names = np.concatenate([points[k] for k in full]).astype(np.uint64)
            first = np.concatenate([[0], np.cumsum([len(points[k]) for k in full])[:-1]])
            names, first = parse(_mixed(names + np.uint64(1)), first)
            names, first = parse(names, first)
            two = _least(names, first, KEEP[0])
            names, first = parse(names, first)
            for k, a, b in zip(full, two, _least(names, first, KEEP[1])):
                out[k] = a, b
        begin = end
    return out


def as_text(s: Sketch) -> str:
    """Level 2 and level 3 as hex, eight digits a hash."""
    return s[0].byteswap().tobytes().hex() + ":" + s[1].byteswap().tobytes().hex()


def likeness(a: Sketch, b: Sketch) -> float:
    """The estimated share of common names."""
    level = 1 if min(len(a[1]), len(b[1])) >= ENOUGH else 0
    x, y = a[level], b[level]
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)
    if max(len(x), len(y)) == KEEP[level]:
        both = both[: KEEP[level]]
    return float((np.isin(both, x, assume_unique=True) & np.isin(both, y, assume_unique=True)).mean())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as many first code points of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _slices(docs: DataFrame, parts: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """docs with _part, a range of _key, and (least key, preceding part) of every part that has rows.

    Only the bounds of the ranges, as many as there are parts, pass through the driver.
    """
    cuts = sorted({int(x) for x in docs.approxQuantile("_key", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    if not cuts:
        sliced = docs.withColumn("_part", F.lit(0))
    else:
        m = math.isqrt(len(cuts)) + 1
        groups = [cuts[k : k + m] for k in range(0, len(cuts), m)]
        below = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col("_key")))
        array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        sliced = docs.withColumn("_group", below(array([g[0] for g in groups])))
        fine = (F.col("_group") - 1) * m + below(F.element_at(F.array(*map(array, groups)), F.greatest("_group", F.lit(1))))
        sliced = sliced.withColumn("_part", F.when(F.col("_group") == 0, 0).otherwise(fine)).drop("_group")
    found = sorted((r[0], r[1]) for r in sliced.groupBy("_part").agg(F.min("_key")).collect())
    return sliced, [(key, found[k - 1][0]) for k, (_, key) in enumerate(found)]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part, then key, each part followed by the first row after it."""
    held = None  # the row that waits for the one after it: part, look, doc_id, text, sketch
    for part in parts:
        texts = part["text"].tolist()
        rows = list(zip(part["_part"].tolist(), part["_look"].tolist(), part["doc_id"].tolist(), texts, sketches([_points(t) for t in texts])))
        pairs = []
        for row in rows:
            if held and not held[1] and held[0] == row[0]:
                pairs.append((held, row))
            held = row
        changed = [edited(a[3], b[3]) for a, b in pairs]
        out = []
        for (a, b), text, s in zip(pairs, changed, sketches([_points(t) for t in changed])):
            i = None if a[2] is None or a[2] != a[2] else int(a[2])
            out.append((i, len(a[3]), hashlib.sha256(text.encode()).hexdigest(), as_text(a[4]), as_text(s), likeness(a[4], s), likeness(a[4], b[4])))
        if out:
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """SCHEMA for every row of docs; texts are shuffled once, by ranges of doc_id."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", whole_text(text).alias("text"), F.col("doc_id").alias("_key"))
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(-(1 << 63))
    keyed = keyed.withColumn("_key", F.coalesce(F.col("_key").cast("long"), unnamed))
    sliced, bounds = _slices(keyed, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:
        return spark.createDataFrame([], SCHEMA)
    heads = spark.createDataFrame(bounds, "_key long, _before int")
    sent = F.array_compact(
        F.array(
            F.struct(F.col("_part").cast("int").alias("part"), F.lit(False).alias("look")),
            F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("part"), F.lit(True).alias("look"))),
        )
    )
    rows = sliced.join(F.broadcast(heads), "_key", "left").withColumn("_to", F.explode(sent))
    rows = rows.select("doc_id", "text", "_key", F.col("_to.part").alias("_part"), F.col("_to.look").alias("_look"))
    ordered = rows.repartition("_part").sortWithinPartitions("_part", "_look", "_key", "text")
    return small_batches(ordered).mapInPandas(_compare, SCHEMA)
