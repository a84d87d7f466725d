import itertools
import random

import numpy as np
import xxhash

from lodestone.llm import simhash
from lodestone.llm.graph import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(fps):
    root = dict(zip(fps, fps))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_golay_decoding_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    index = simhash.decode(words)
    clean = simhash.decode(index << 11 ^ simhash._tables()[0][index])
    assert (clean == index).all()
    assert (np.bitwise_count(words ^ (index << 11 ^ simhash._tables()[0][index])) <= 3).all()


def test_every_link_of_four_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << k
        at, keys = simhash.pair_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())


def test_fingerprint_matches_the_plain_one():
    rng = random.Random(3)
    for t in ["", " \n", "One", "a B c", "a b c d", "x\x1cy z\x85w q", "É é ß 東京 a", *(" ".join(rng.choice(["aB", "c", "Dé", "e"]) for _ in range(k)) for k in (4, 5, 9, 200))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:3]:
        chain = base
        for _ in range(120):
            for k in rng.sample(range(64), rng.randint(1, 4)):
                chain ^= 1 << k
            fps.append(chain)
    dense = rng.getrandbits(64)
    for _ in range(260):
        x = dense
        for k in rng.sample(range(30), rng.randint(1, 3)):
            x ^= 1 << k
        fps.append(x)
    want = plain_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), size=40)).collect()
    mine = {r.node % (1 << 64): r.root for r in got}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert {g for g in groups(mine)} == {g for g in groups(want) if len(g) > 1}


def test_cases(spark):
    rows = [(5, None, 1), (3, "", 2), (7, "a b c d e f g", 3), (7, "a b c d e f g", 3), (6, "a  b c D e f g", 4), (None, "a b c d e f g", 5), (9, "only this other text here now", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.digests(df).collect()))
    assert [(a, c) for a, _, c in got] == [(-1, 6), (3, 3), (5, 3), (6, 6), (7, 6), (7, 6), (9, 9)]
    assert got[1][1] == "0" * 16
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["3", "6", "9"]
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.digests(df.limit(0)).count() == 0


def test_different_texts_under_one_id_or_none_stay(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "entirely other words are in this one", "and these are of no other text"]
    rows = [(5, texts[0], 1), (5, texts[1], 1), (None, texts[2], 1), (None, texts[3], 1), (None, texts[3], 1), (None, texts[0], 1), (5, texts[0], 1), (5, texts[1], 2)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _content int")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(5, texts[0]), (5, texts[1]), (-1, texts[2]), (-1, texts[3])])
    assert sorted(got, key=str) == sorted(simhash.keep_one(spark.createDataFrame(rows[::-1], "doc_id long, text string, _content int").repartition(5)).collect(), key=str)


def test_a_text_of_very_many_shingles(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(5000)]
    text = " ".join(rng.choice(vocabulary) for _ in range(70_000))
    other = text.replace(" ", "\n", 9) + " tail"
    got = {r.doc_id: r for r in simhash.digests(spark.createDataFrame([(1, text, "x"), (2, other, "y"), (3, "short", None)], "doc_id long, text string, fp string")).collect()}
    words = text.split(" ")
    counts = [0] * 64
    for i in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 3)
    assert got[1].fingerprint == f"{want:016x}"
    assert got[2].component_id == 1 and got[3].component_id == 3
