"""Filter interactions against filters applied one after the other in plain Python."""

import random
import re
from itertools import permutations

import numpy as np

from lodestone.llm import bitmaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    mark = {k: tuple(max(int(r[i] == 1) for r in labels if r[0] == k) for i in (1, 2)) for k in {r[0] for r in labels} - {None}}
    parts = {}
    for doc, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and first[t] < doc}
        parts.setdefault(lang or "", []).append(({x for x, y in fails.items() if y}, *mark.get(doc, (0, 0))))
    out = []
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for k, x in enumerate(order):
                here = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                steps.append((part, "".join(order), k + 1, len(left), len(here), sum(x in d[0] for d in gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)))
                gone = gone + here
                shapley[x] += len(here)
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, mask int, digest string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in bitmaps.interactions(docs, marks).collect())


def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(260):
        n = rng.choice([0, 5, 99, 100, 101, 130])
        words = [rng.choice(["Up", "UPPER", "low", "c$h", "ä", "a|b"]) if rng.random() < 0.3 else f"w{rng.randint(0, rng.choice([20, 2000]))}" for _ in range(n)]
        rows.append((k, rng.choice([" ", "\n", "\x0b "]).join(words), rng.choice(["en", "en", "de", None, ""])))
    rows += [(1000 + k, rows[rng.randint(0, 40)][1], rng.choice(["en", "fr"])) for k in range(120)]
    rows += [(2000, None, None), (2001, "", "en"), (None, rows[3][1], "en"), (None, rows[3][1], "en"), (5, rows[5][1], "de"), (7, "another text", "en")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 1100, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    rng.shuffle(rows)
    return rows, labels


def test_counts_of_every_order(spark):
    rows, labels = corpus()
    assert found(spark, rows, labels) == brute(rows, labels)


def test_batches_and_tasks_add_up(spark):
    rows, labels = corpus()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, rows, labels) == brute(rows, labels)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_many_parts_are_passed_on_in_turn(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(bitmaps, "HELD", 3)
    batch = pd.DataFrame({"part": [f"p{k % 9}" for k in range(40)], "mask": [k % 32 for k in range(40)], "good": 1, "toxic": 0})
    whole = pd.concat(list(bitmaps._tally(iter([batch, batch]))))
    sums = whole[(whole.prefix == 0) & (whole["filter"] == 0)].groupby("part").removed.sum()
    assert sums.sum() == 2 * sum(k % 32 & 1 for k in range(40)) and len(sums) == 9


def test_bitsets_of_one_part():
    own = np.array([0b00111100], np.uint8)
    fails = [np.array([x], np.uint8) for x in (0b00000100, 0b00001100, 0, 0, 0b10000000)]
    got = bitmaps.steps(own, fails, np.array([0b00000100], np.uint8), np.array([0], np.uint8))
    assert got[0, 0].tolist() == [3, 1, 0, 0, 1, 0] and got[0b10, 0].tolist() == [2, 0, 1, 0, 0, 0] and got[0, 1].tolist() == [2, 2, 0, 1, 1, 0]


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "Wort " * 400_000, "de"), (2, "Wort " * 400_000, "de"), (3, "x" * 3_000_000, "de")]
    assert found(spark, rows, [(1, 1, 0)]) == brute(rows, [(1, 1, 0)])
    assert found(spark, [], []) == []
