import hashlib
import random

import numpy as np

from lodestone.llm import parsing


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé東") for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_equal_substrings_share_interior_phrases_at_any_offset():
    rng = random.Random(1)
    common = words(rng, 150)

    def phrases(text):
        names, first = parsing.parse(parsing._mixed(parsing._points(text).astype(np.uint64) + np.uint64(1)), np.array([0]))
        return set(parsing.parse(names, first)[0].tolist())

    alone = phrases(common)
    for shift in range(7):
        inside = phrases(words(rng, 20) + " " * shift + common + words(rng, 20))
        assert len(alone & inside) > 0.9 * len(alone)


def test_runs_and_levels_are_local():
    for text in ["aaaaaaaaaaaaaaaa", "ab" * 5000, "a", "ab", "aab", "é" * 70000]:
        s = parsing.sketches([parsing._points(text)] * 2)
        assert parsing.as_text(s[0]) == parsing.as_text(s[1]) and parsing.likeness(*s) == 1.0


def test_batches_do_not_change_a_sketch():
    rng = random.Random(2)
    texts = ["", "x", *(words(rng, rng.randint(1, 400)) for _ in range(40)), ""]
    together = parsing.sketches([parsing._points(t) for t in texts])
    for t, s in zip(texts, together):
        assert parsing.as_text(s) == parsing.as_text(parsing.sketches([parsing._points(t)])[0])


def test_against_a_plain_pass_over_the_sorted_documents(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 401, words(rng, rng.choice([0, 1, 3, 40, 300]))) for i in range(401)] + [(1000, None), (-5, "🙂" * 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in parsing.fingerprints(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    near, apart = [], []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        e = t[: len(t) - k] + u[:k]
        a, b, c = parsing.sketches([parsing._points(x) for x in (t, e, u)])
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (parsing.as_text(a), parsing.as_text(b))
        assert (r.near_edited, r.near_next) == (parsing.likeness(a, b), parsing.likeness(a, c))
        if len(t) > 500:
            near.append(r.near_edited), apart.append(r.near_next)
    assert np.mean(near) > 0.5 and np.mean(apart) < 0.1


def test_few_rows_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    one = parsing.fingerprints(spark.createDataFrame([(4, "abcd")], schema)).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    many = parsing.fingerprints(spark.createDataFrame([(None, "q"), (2, "abcdefgh"), (2, "abcdefgh"), (None, None)], schema)).collect()
    assert len(many) == 4 and sorted(str(r.doc_id) for r in many) == ["2", "2", "None", "None"]
    assert parsing.fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_documents_without_an_id_are_neighbours_by_hash(spark):
    rows = [(None, f"text number {k} of those without an id") for k in range(300)] + [(k, f"named {k}") for k in range(20)]
    got = parsing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    again = parsing.fingerprints(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sorted(r.edited_sha256 for r in got) == sorted(r.edited_sha256 for r in again)
    assert len({r.edited_sha256 for r in got}) > 300
