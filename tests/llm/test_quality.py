import random
import zlib

import numpy as np
import pytest

from lodestone.llm import quality


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "an", "in", "on", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        body = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        text = " ".join((w.upper() + "!!" if rng.random() < 0.8 else w) for w in body) if bad else " ".join(body) + "."
        docs.append((i, text, "src", len(text)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_pairwise_identity():
    rng = np.random.default_rng(3)
    m = quality.Model(np.zeros(15), np.ones(15), 0.3, rng.normal(size=40), rng.normal(size=(40, 5)))
    at, x = rng.permutation(40)[:12], rng.normal(size=12)
    slow = 0.3 + m.w[at] @ x + sum(m.v[a] @ m.v[b] * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert m.raw(at, x) == pytest.approx(slow)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.digests(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(docs)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    again = {r.doc_id: r.score for r in quality.digests(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_two_labels_of_a_document_and_columns_of_the_same_names(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    of = lambda rows: {r.doc_id: r.score for r in quality.digests(d, spark.createDataFrame(rows, "doc_id long, quality int, text string")).collect()}
    one = [(i, q, "x") for i, q, _ in labels]
    clash = [i for i, _, _ in labels if i % 5 == 0]
    both = one + [(i, 1 - q, "y") for i, q, _ in one if i in clash]
    assert of(both) == of(both[::-1]) == of([r for r in one if r[0] not in clash])


def test_cases(spark):
    schema = "doc_id long, text string, n_chars long, score string"
    d = spark.createDataFrame([(1, None, None, "x"), (None, "", 0, "y"), (2, "a b", 3, "z"), (2, "a b", 3, "z"), (3, " \n", 2, "")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.digests(d, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score == 1 for r in quality.digests(d, one).collect())
    assert quality.digests(d.limit(0), one).count() == 0
    assert quality.accepted(d, one).columns == d.columns
    m = quality.fit([(*quality.words_and_statistics(t), True) for t in ["a b", "A!! B!!", "", "x" * 100000, None or " "]], np.array([1, 0, 0, 1, 0]))
    assert all(0 <= m.score(t, 1) <= 1 for t in ["", "word " * 30000, "é" * 70000, "\x00"])
