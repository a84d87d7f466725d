"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the last term is the sum of all
pairwise interactions <v_i, v_j> x_i x_j in time linear in the features present. Features are the words of the
whole text (hashed, damped counts scaled to length 1), statistics of its structure and the metadata of the row (the logarithm
of its n_chars column), each as a standardised number and as a bin, and whether n_chars agrees with the text. labels, lang,
source and doc_id never enter a score.

The model is fitted on at most FIT_ROWS labelled rows of at most FIT_WORDS distinct words each, taken by the hash of doc_id from
those that are not held out (crc32(doc_id as text) mod 4 = 2 is held out). It is small (BUCKETS x (1 + FACTORS) numbers) whatever the input, and is
broadcast; scoring touches each document once, with no shuffle.

Defined cases: a null text counts as empty and is scored; null n_chars counts as 0 and as disagreeing; rows labelled null, and
documents that have both labels, are not used; repeated documents get equal scores; without labels of both kinds the score is the share of label 1 (0.5 without any
label); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import free, small_batches, whole_text

FIT_ROWS, FIT_WORDS = 6000, 8192
BUCKETS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 1 << 16, 6, 6, 128, 0.08, 1e-5
THRESHOLD = 0.7
#: Inner edges of the bins of each statistic, as standard scores.
EDGES = np.array([-1.5, -0.75, -0.25, 0.25, 0.75, 1.5])

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sign, 6 byte of a longer code point
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[_SPACE] = 1, 2, 3, 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_KIND[128:] = 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. mod 2^64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64))])
    return _powers[0], _powers[1]


STATISTICS = (
    "log_bytes", "upper", "digit", "sign", "long_points", "other", "word_bytes", "distinct_words", "commonest_word",
    "repeats_last_word", "words_with_inner_signs", "distinct_lines", "words_a_line", "sentence_ends", "all_upper_words", "log_n_chars",
)


def words_and_statistics(text: str, n_chars=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, their damped counts scaled to length 1, and the statistics, n_chars as the last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    stats = np.zeros(len(STATISTICS))
    n = len(raw)
    stats[0], stats[15] = np.log1p(n), np.log1p(max(n_chars or 0, 0))
    if not n:
        return np.empty(0, np.int64), np.empty(0), stats
    kind = _KIND[raw]
    share = np.bincount(kind, minlength=7) / n
    stats[1:6] = share[2], share[3], share[5], share[6], share[0]
    gap = kind == 4
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    m = len(start)
    if not m:
        return np.empty(0, np.int64), np.empty(0), stats
    up, down = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])])
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    distinct, counts = np.unique(h, return_counts=True)
    sign = np.concatenate([[0], np.cumsum(kind == 5)])
    high = np.concatenate([[0], np.cumsum(kind == 2)])
    low = np.concatenate([[0], np.cumsum(kind == 1)])
    stats[6] = (end - start).mean()
    stats[7] = len(distinct) / m
    stats[8] = counts.max() / m
    stats[9] = (h[1:] == h[:-1]).mean() if m > 1 else 0.0
    stats[10] = (sign[end] - sign[start] > 1).mean()
    breaks = np.flatnonzero(raw == 10)
    bounds = np.concatenate([[0], breaks, [n]])
    lines = sums[bounds[1:]] - sums[bounds[:-1]]
    lines = lines * down[bounds[:-1]]
    stats[11] = len(np.unique(lines)) / len(lines)
    stats[12] = np.log1p(m / len(lines))
    stats[13] = np.isin(raw[end - 1], (33, 46, 63)).mean()
    stats[14] = ((high[end] - high[start] > 0) & (low[end] == low[start])).mean()
    bucket = (distinct >> np.uint64(48)).astype(np.int64)
    value = np.log1p(counts)
    return bucket, value / np.sqrt((value * value).sum()), stats


@dataclass
class Model:
    """Weights of BUCKETS words, then of each statistic as a number, its bins, and the metadata feature."""

    mean: np.ndarray
    spread: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def features(self, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, agrees: bool) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.spread, -4, 4)
        k = len(STATISTICS)
        bins = BUCKETS + k + np.arange(k) * (len(EDGES) + 1) + np.searchsorted(EDGES, z)
        own = np.concatenate([BUCKETS + np.arange(k), bins, [BUCKETS + k * (len(EDGES) + 2)]])
        return np.concatenate([bucket, own]), np.concatenate([value, z / 2, np.ones(k), [float(agrees)]])

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        """Linear and pairwise part, in time linear in len(index)."""
        p = self.v[index] * x[:, None]
        s = p.sum(axis=0)
        return float(self.bias + self.w[index] @ x + 0.5 * (s @ s - (p * p).sum()))

    def score(self, text: str, n_chars) -> float:
        if not len(self.w):
            return self.bias
        agrees = n_chars is not None and n_chars == len(text)
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.features(*words_and_statistics(text, n_chars), agrees)), -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]], labels: np.ndarray) -> Model:
    """AdaGrad on the logistic loss over a bounded list of featurised rows."""
    if not len(rows) or labels.min() == labels.max():
        return Model(np.empty(0), np.empty(0), float(labels.mean()) if len(rows) else 0.5, np.empty(0), np.empty((0, FACTORS)))
    rng = np.random.default_rng(7)
    stats = np.array([r[2] for r in rows])
    width = BUCKETS + len(STATISTICS) * (len(EDGES) + 2) + 1
    model = Model(stats.mean(axis=0), stats.std(axis=0) + 1e-6, 0.0, np.zeros(width), rng.normal(0, 0.02, (width, FACTORS)))
    data = [model.features(*r) for r in rows]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    gw, gv, gb = np.full(width, 1e-3), np.full((width, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for k in range(0, len(order), BATCH):
            take = order[k : k + BATCH]
            index = np.concatenate([data[i][0] for i in take])
            x = np.concatenate([data[i][1] for i in take])
            sizes = np.array([len(data[i][0]) for i in take])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            p = model.v[index] * x[:, None]
            s = np.add.reduceat(p, first)
            raw = model.bias + np.add.reduceat(model.w[index] * x, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((p * p).sum(1), first))
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[take]) * weight[take] / len(take)
            e = np.repeat(err, sizes)
            dv = (e * x)[:, None] * (np.repeat(s, sizes, axis=0) - p)
            at, back = np.unique(index, return_inverse=True)
            g1 = np.bincount(back, e * x) + DECAY * model.w[at]
            g2 = np.column_stack([np.bincount(back, dv[:, f]) for f in range(FACTORS)]) + DECAY * model.v[at]
            gw[at] += g1 * g1
            gv[at] += g2 * g2
            gb += err.sum() ** 2
            model.w[at] -= RATE * g1 / np.sqrt(gw[at])
            model.v[at] -= RATE * g2 / np.sqrt(gv[at])
            model.bias -= RATE * err.sum() / np.sqrt(gb)
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never used."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of at most `rows` labelled rows of docs that are not held out."""
    ids = (
        labels.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where(F.col("quality") == F.col("_most")).select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = docs.select("doc_id", "text", "n_chars").join(F.broadcast(ids), "doc_id")

    def featurise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t, n, q, i in zip(part["text"], part["n_chars"], part["quality"], part["doc_id"]):
                t = t or ""
                n = None if n is None or n != n else n
                b, v, s = words_and_statistics(t, n)
                if len(b) > FIT_WORDS:
                    continue
                out.append((i, q, b.astype(np.int32).tobytes(), v.astype(np.float32).tobytes(), s.tobytes(), n == len(t)))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "b", "v", "s", "agrees"])

    got = small_batches(known).mapInPandas(featurise, "doc_id long, quality int, b binary, v binary, s binary, agrees boolean").toPandas()
    got = got.sort_values(["doc_id", "b", "v", "s"], kind="stable").drop_duplicates("doc_id")
    of = np.frombuffer
    data = [(of(r.b, np.int32).astype(np.int64), of(r.v, np.float32).astype(float), of(r.s), bool(r.agrees)) for r in got.itertuples()]
    return fit(data, got["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars", out: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def run(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t, None if n != n else n) for t, n in zip(texts, sizes)], dtype="float64")

    return small_batches(docs).withColumn(out, run.asNondeterministic()(whole_text(text), F.col(n_chars).cast("double")))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text", "n_chars"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD."""
    own = free("_score", docs)
    return score(docs, train(docs, labels), out=own).where(F.col(own) >= THRESHOLD).drop(own)
