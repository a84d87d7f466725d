import random

import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import bpe
from lodestone.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(5)
    yield from ["", " ", "a", "\n\n \t x", "the the the", "aaaaaaaaaaaaaaaaa" * 40, "né à Zürich 東京 🙂🙂 12345", "<|endoftext|>", "x" * 5000, "​﻿\x00\x01"]
    for _ in range(150):
        yield "".join(rng.choice("ab eéöß東\n'sT01.-🙂") for _ in range(rng.randint(1, 80)))


def test_equals_the_library_and_round_trips(theirs):
    c = bpe.Codec(RANKS, PATTERN)
    for t, ids in zip(texts(), c.encode(list(texts()))):
        assert list(memoryview(ids).cast("I")) == theirs.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_one_piece_and_many_pieces_merge_alike():
    c = bpe.Codec(RANKS, PATTERN)
    rng = random.Random(7)
    pieces = {bytes(rng.choice(b"abnthe ring\xc3\xa9\xff") for _ in range(rng.randint(2, 64))) for _ in range(400)}
    pieces = sorted(p for p in pieces if p not in c.ranks)
    for width in (2, 4, 8, 16, 32, 64):
        part = [p for p in pieces if 1 << (len(p) - 1).bit_length() == width]
        for p, ids in zip(part, bpe.merge_pieces(part, c.pairs, width) if part else []):
            assert list(memoryview(ids).cast("I")) == bpe.merge_piece(p, c.ranks)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, b"x"), (2, "ab ab", b"y"), (2, "ab ab", b"y"), (None, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in out] == [b"ab", b"", b"ab ab", b"ab ab"] and bytes(out[1].ids) == b""
    assert bpe.digests(df.limit(0), RANKS, PATTERN).count() == 0
    assert [r.n_tokens for r in bpe.digests(df, RANKS, PATTERN).orderBy("doc_id").collect()][1] == 0


def test_a_very_long_text_through_the_query(spark, theirs):
    rows = [(1, "the né ring " * 200_000 + "x" * 3000), (2, "東京" * 50_000)]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, PATTERN).collect()
    assert all(list(memoryview(bytes(r.ids)).cast("I")) == theirs.encode_ordinary(r.text) for r in out)
