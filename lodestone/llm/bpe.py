"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded on its own. Its merges are driven by a segment tree over byte
positions: a leaf holds (rank, position) of the pair that starts there, an inner node the least of its children,
so the root is the leftmost pair of the least rank. A merge changes two live neighbours and removes one leaf:
three point updates, each logarithmic in the length of the piece. New pieces of up to WIDE bytes are merged side by side,
one tree a row of an array; longer ones one by one.

Defined cases: a null text counts as empty and gives no ids; texts, however long, are encoded whole; repeated
rows are encoded alike; an empty table gives an empty table; every other column passes through, and a column that
already has an output name is replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import small_batches, whole_text

#: A worker remembers this many pieces at most, in two halves: a full half replaces the older one. Results never depend on it.
MEMO_PIECES = 240_000
MEMO_CHARS = 32
#: Characters of texts whose new pieces are encoded together; rows of one call and bytes of a piece there at most.
GROUP, ROWS, WIDE = 300_000, 8192, 64
#: More than any rank and place.
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file. A name without a folder is a public vocabulary, looked up where its library lies on this machine."""
    if not os.path.dirname(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by point updates of a segment tree of pair ranks."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    none = 1 << 62
    width = 1 << max(1, (n - 2).bit_length())
    tree = [none] * (2 * width)
    after = list(range(1, n + 2))  # start of the next live token
    before = list(range(-1, n))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while (top := tree[1]) != none:
        i = top & 0xFFFFFFFF
        j = after[i]
        end = after[j]
        after[i] = end
        if end <= n:
            before[end] = i
        put(j, none) if j < n - 1 else None
        r = get(piece[i : after[end]]) if end < n else None
        put(i, none if r is None else r << 32 | i)
        if (h := before[i]) >= 0:
            r = get(piece[h:end])
            put(h, none if r is None else r << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """Rank of two neighbouring tokens by their ids: every way to cut a token in two tokens, as sorted numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values(), default=-1) + 1
        get, pairs = ranks.get, []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = get(token[:k])
                if left is not None and (right := get(token[k:])) is not None:
                    pairs.append((left * self.base + right, rank))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.ranks = np.array([r for _, r in pairs] + [NONE >> 8], np.int64)
        self.bytes = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE >> 8 where the two do not merge."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE >> 8)


def merge_pieces(pieces: list[bytes], pairs: PairTable, width: int) -> list[bytes]:
    """Packed ids of many pieces of 2 to `width` bytes: as merge_piece, one segment tree a row, all rows a merge at a time.

    width is a power of two, 64 at most.
    """
    m, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    span = width + 1
    raw = np.frombuffer(b"".join([p.ljust(span, b"\0") for p in pieces]), np.uint8).reshape(m, span)
    inside = np.arange(span) < size[:, None]
    token = np.where(inside, pairs.bytes[raw], 0)
    after = np.broadcast_to(np.arange(1, span + 1), (m, span)).copy()
    before = np.broadcast_to(np.arange(-1, width), (m, span)).copy()
    tree = np.full((m, 2 * width), NONE, np.int64)
    leaves = np.where(inside[:, 1:], pairs(token[:, :-1], token[:, 1:]), NONE >> 8)
    tree[:, width:] = leaves << 8 | np.arange(width)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    tree, token, after, before = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    row = np.arange(m)
    while True:
        top = tree[row * (2 * width) + 1]
        live = top < NONE
        if not live.all():
            row, top = row[live], top[live]
        if not len(row):
            break
        at, root, n = row * span, row * (2 * width), size[row]
        i, rank = top & 255, top >> 8
        j = after[at + i]
        end = np.minimum(after[at + j], n)
        h = before[at + i]
        token[at + i], after[at + i], before[at + end] = rank, end, i
        token[at + j] = -1
        none, first = NONE >> 8, np.maximum(h, 0)
        here = np.where(end < n, pairs(rank, token[at + np.minimum(end, width)]), none)
        prior = np.where(h >= 0, pairs(token[at + first], rank), none)
        tree[root + width + j] = NONE
        tree[root + width + i] = here << 8 | i
        some = h >= 0
        tree[(root + width + h)[some]] = (prior << 8 | h)[some]
        k = [width + i, width + j, width + first]
        level = width
        while level > 1:
            k = [x >> 1 for x in k]
            level >>= 1
            for x in k:
                child = root + 2 * x
                tree[root + x] = np.minimum(tree[child], tree[child + 1])
    token, inside = token.reshape(m, span), inside & (token.reshape(m, span) >= 0)
    ends = np.cumsum(inside.sum(axis=1)) * 4
    packed = token[inside].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec(dict):
    """str piece -> its ids as little-endian unsigned 32-bit integers; filled as pieces are met."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}
        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.split = regex.compile(pattern).findall
        self.vocabulary = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        ids = self.rare.get(piece)
        return np.array(merge_piece(piece.encode(), self.ranks), "<u4").tobytes() if ids is None else ids

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet; those of up to WIDE bytes together."""
        self.rare = {}
        if len(self) >= MEMO_PIECES // 2:
            self.older = dict(self)
            self.clear()
        sized: dict[int, list[str]] = {}
        for piece in pieces:
            if piece in self or piece in self.older:
                continue
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self[piece] = rank.to_bytes(4, "little")
            elif len(raw) <= WIDE:
                sized.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
        for width, group in sized.items():
            for k in range(0, len(group), ROWS):
                part = group[k : k + ROWS]
                for piece, ids in zip(part, merge_pieces([p.encode() for p in part], self.pairs, width)):
                    (self if len(piece) <= MEMO_CHARS else self.rare)[piece] = ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, GROUP characters of texts at a time."""
        held, chars = [], 0
        for k, text in enumerate(texts):
            held.append(self.split(text))
            chars += len(text)
            if chars >= GROUP or k == len(texts) - 1:
                self.learn(set(chain.from_iterable(held)))
                for pieces in held:
                    yield b"".join([self[p] for p in pieces])
                held, chars = [], 0

    def decode(self, ids: bytes) -> bytes:
        vocabulary = self.vocabulary
        return b"".join([vocabulary[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`: the ids of each whole text, packed as little-endian unsigned 32-bit integers."""

    @pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in parts:
            yield pd.Series(list(c.encode(s.tolist())), dtype=object)

    return small_batches(docs).withColumn(ids, run.asNondeterministic()(whole_text(text)))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with `out`: the bytes that the ids stand for; null ids count as none."""

    @pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in parts:
            yield pd.Series([c.decode(t) for t in s], dtype=object)

    return small_batches(encoded).withColumn(out, run.asNondeterministic()(F.coalesce(F.col(ids), F.lit(b""))))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    both = decode(encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
