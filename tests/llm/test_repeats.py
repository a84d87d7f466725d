import hashlib
import random

import pytest

from lodestone.llm import repeats


def plain(rows):
    """Every 100-byte string at its first place; bytes of later ones go."""
    seen, gone = {}, []
    docs = sorted(((d if d is not None else -(1 << 63)), (t or "").encode(), k) for k, (d, t) in enumerate(rows))
    for d, raw, _ in docs:
        for p in range(len(raw) - 99):
            seen[raw[p : p + 100]] = min(seen.get(raw[p : p + 100], (d, p)), (d, p))
    out = {}
    for d, raw, k in docs:
        hit = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if seen[raw[p : p + 100]] < (d, p):
                hit[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out[k] = (len(raw), sum(hit), sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    say = lambda k: " ".join(word() for _ in range(k))
    shared = [say(rng.randint(3, 60)) for _ in range(12)]
    line = say(6)
    rows = []
    for i in range(n):
        parts = [say(rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 8) :] for _ in range(rng.randint(0, 7))]
        parts.insert(0, line)
        rows.append((i * 7 % 1000, rng.choice(["", " ", "--"]).join(parts)))
    rows += [(2000 + i, rows[3][1]) for i in range(4)] + [(3000, "ab" * 300), (3001, "x" * 500), (3002, ("y" * 40 + "z") * 9), (3003, None), (3004, "")]
    for i in range(15):
        t = list(rows[5][1])
        for _ in range(3):
            t[rng.randrange(len(t))] = "#"
        rows.append((4000 + i, "".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(df.repartition(3)).collect()}
    assert got == {rows[k][0]: v for k, v in want.items()}


def test_the_tree_equals_the_windows_of_hot_grams(spark, monkeypatch):
    import pandas as pd

    rng = random.Random(4)
    frequent = "".join(rng.choice("abcdefgh") for _ in range(130)).encode()
    rows = []
    for i in range(300):
        a, b = bytes(rng.choice(b"xy") for _ in range(rng.randint(0, 60))), bytes(rng.choice(b"xy") for _ in range(90))
        raw = a + frequent[rng.randint(0, 40) : rng.randint(100, 130)] + b
        rows += [(d, i, at, left, raw[at - left : at + right], g) for d, at, left, right, g in _anchors_of(raw, i)]
    frame = pd.DataFrame([(g, d, at << 16 | left << 8 | (len(c) - left), c) for d, _, at, left, c, g in rows], columns=["gram", "doc", "spot", "context"])

    def covered(parts):
        cut = frame.assign(part=0 if parts == 1 else (frame["doc"] * 7 + frame["spot"]) % parts, frequent=parts > 1).sort_values(["gram", "part", "doc", "spot"])
        got = pd.concat(list(repeats._tree(iter([cut[:100], cut[100:]]))))
        plain_spans = got[got.key == 0]
        hot = got[got.key != 0].sort_values(["doc", "start"])
        hot = hot[hot.groupby(["gram", "key"]).cumcount() > 0]
        spans = {}
        for d, a, b in pd.concat([plain_spans, hot])[["doc", "start", "stop"]].itertuples(index=False):
            spans.setdefault(d, []).append((a, b))
        return {d: repeats.merged(s) for d, s in spans.items()}

    assert covered(1) == covered(2) == covered(5) == covered(40)


def _anchors_of(raw, doc):
    own, at, left, right, gram, _ = repeats.anchors([raw])
    return [(doc, int(a), int(x), int(y), int(g >> 1)) for a, x, y, g in zip(at, left, right, gram)]


def test_frequent_grams_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", 6)
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefgh ", k=170))
    rows = [(i, "".join(rng.choices("xyz ", k=rng.randint(0, 150))) + line[rng.randint(0, 60) :] * rng.randint(1, 2) + "".join(rng.choices("xyz ", k=80))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone |= {*range(k, k + 100)}
            seen.add(raw[k : k + 100])
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_repeated_rows_nulls_and_empty(spark):
    t = "".join(random.Random(5).choices("abcdefghij", k=400))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in repeats.digests(df).collect())
    assert got == [("1", 400, 1), ("1", 400, 1), ("2", 800, 1), ("None", 0, 0)]
    assert repeats.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("many", [4096, 6])
def test_texts_of_one_id_or_none_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rng = random.Random(9)
    say = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passages = [say(180) for _ in range(4)]
    texts = [rng.choice(["", say(40), say(200)]) + rng.choice(passages)[rng.choice([0, 0, 30]) :] + say(120) for _ in range(60)]
    rows = [(rng.choice([None, None, 7, i]), t, str(i)) for i, t in enumerate(texts)]
    rows += [(None, rows[0][1], "60"), (7, rows[1][1], "61")]
    want = plain([r[:2] for r in rows])
    got = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3)).collect()
    as_text = lambda d, v: (str(d), *v)
    assert sorted(as_text(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(as_text(rows[k][0], v) for k, v in want.items())


def test_a_text_longer_than_what_is_hashed_at_once(spark):
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=repeats.AT_ONCE + 50_000))
    rows = [(1, long[:900] + "-" + long[repeats.AT_ONCE - 300 : repeats.AT_ONCE + 300]), (2, long), (3, "x" + long[500_000:500_400])]
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 0), (2, 1500, 2), (3, 400, 1)]
