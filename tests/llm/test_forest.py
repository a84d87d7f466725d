"""LSH forest near-duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import forest

SCHEMA = "doc_id long, text string, n long, _n string, node int"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3)))


def brute(rows):
    """(doc_id, n_shingles, component_id) of every (doc_id, text), sorted."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in forest.near_duplicates(df, **how).collect()), key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.randint(1, 8)):
            text = [w if rng.random() > rng.choice([0, 0.01, 0.04, 0.08]) else word() for w in base]
            rows.append((k, rng.choice([" ", "\n\t"]).join(text)))
            k += 1
    rng.shuffle(rows)
    return rows


EDGE = [
    (900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (906, "one two three four"), (907, "one two three four five"),
    (None, "one two"), (None, "nobody else says this at all"), (None, None), (908, "ÄÖ eins zwei drei"), (909, "äö eins zwei drei"), (910, "one two three"),
    (903, "One two"), (903, "a text of its own under an id that repeats"),
]


@pytest.mark.parametrize("how", [{}, {"chunk": 2}, {"bulk": 300}])
def test_components_are_those_of_all_pairs(spark, how):
    """Whole regions; chunks of two rows, or of few shingles, so that most links are found across chunks."""
    rows = corpus() + EDGE
    assert found(spark, rows, **how) == brute(rows)


def test_the_borders_of_the_threshold(spark):
    words = [f"w{k}" for k in range(12)]
    # nine shingles each, eight shared of ten in all: 0.8; then seven shared of eleven
    rows = [(1, " ".join(words)), (2, " ".join([*words[:11], "x"])), (3, " ".join(["y", *words[1:10], "p", "q"]))]
    assert found(spark, rows) == brute(rows) and [c for _, _, c in brute(rows)] == [1, 1, 3]


def test_a_dense_group_whose_pairs_are_mostly_no_links(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(120)]
    rows = [(k, " ".join(w if rng.random() > rng.choice([0, 0.02, 0.05]) else word() for w in base)) for k in range(180)]
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < 150
    assert found(spark, rows) == want and found(spark, rows, chunk=20) == want


def test_regions_of_one_component_are_not_opened_again(spark):
    regions = spark.createDataFrame([(0, 5, k, k, k // 3) for k in range(9)] + [(1, 6, 0, 1, 0), (1, 6, 0, 2, 0)], "tree int, key long, deep long, node long, chunk long")
    one = spark.createDataFrame([(k, 0) for k in range(9)], "node long, root long")
    assert forest.across(regions, one).count() == 0
    units = forest.across(regions, one.where("node <> 8")).collect()
    assert len(units) == 18 and {(r.a, r.b) for r in units} == {(0, 1), (0, 2), (1, 2)} and all(r.chunk in (r.a, r.b) for r in units)


def test_the_ends_of_ranges_keep_their_neighbours(spark):
    """Rows of one region that fall into different ranges still meet."""
    docs = spark.createDataFrame([(k, f"one two three four five six {k}") for k in range(40)], "doc_id long, text string")
    nodes = forest.written(forest.signed(docs).withColumnRenamed("doc_id", "node"), "nodes")
    got = forest.orders(nodes).groupBy("tree", "key").count().where("count > 1").count()
    m = forest._matrix(nodes.toPandas()["signature"])
    runs = sum((forest.np.unique(forest._order(m, t)[0], return_counts=True)[1] > 1).sum() for t in range(forest.TREES))
    assert got == runs


def test_signatures_estimate_similarity_and_long_texts_are_whole(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**64, 9000, np.uint64)
    a, b = np.unique(s[:8000]), np.unique(s[1000:])
    agree = np.mean(forest.signature(a) == forest.signature(b))
    assert abs(agree - 7 / 9) < 0.16
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " and one more word here"), (3, long[: len(long) // 2])]
    assert found(spark, rows) == [(1, 299_997, 1), (2, 300_002, 1), (3, brute([rows[2]])[0][1], 3)]


def test_digests_and_empty_tables(spark):
    docs = spark.createDataFrame([(2, "a b c d"), (1, "A b c d"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in forest.digests(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, None)}
    assert forest.digests(docs.limit(0)).count() == 0
    assert forest.digests(docs.where("text is null")).count() == 1
