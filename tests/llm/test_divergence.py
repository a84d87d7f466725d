"""Source divergences against whole-number arithmetic in plain Python, and the query against its SQL."""

import os
import random
import re

import duckdb
import pytest

from lodestone.llm import divergence, queries
from tests.test_oracle import rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, support=3, top=200):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", TERM.findall(lower(text))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = {}
        for _, _, words in own:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        kept = {w for w, n in seen.items() if n >= support}
        count = {s: dict.fromkeys(kept, 0) for s in {d[1] for d in own}}
        for _, s, words in own:
            for w in words:
                if w in kept:
                    count[s][w] += 1
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        p = {s: {w: share(c, sum(cs.values())) for w, c in cs.items()} for s, cs in count.items()}
        every = {w: sum(cs[w] for cs in count.values()) for w in kept}
        q = {w: share(c, sum(every.values())) for w, c in every.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in count if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, *r, 1, "m") for k, r in enumerate(rows)], "doc_id int, lang string, source string, text string, n int, vector string")
    return sorted(tuple(r) for r in divergence.divergences(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n=300):
    rng = random.Random(8)
    words = ["der", "Das", "naïve", "Übung", "übung", "é", " ", "日本", "don't", "x1y", *("t" + chr(97 + k % 26) * (k // 26 + 1) for k in range(150))]
    return [
        (rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "ü", None, ""]), " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))))
        for _ in range(n)
    ]


def test_values_and_ranks(spark):
    rows = corpus() + [("en", "empty", ""), ("en", "nothing", None), ("fr", "a", "one"), ("fr", "b", "two"), ("it", "only", "uno uno uno"), (None, None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, support=1, top=5) == brute(rows, 1, 5)


def test_terms_of_equal_vectors_count_once_each(spark):
    rows = [("en", "a", "red green blue")] * 4 + [("en", "b", "red")] * 3 + [("en", "c", "x y z")]
    got = found(spark, rows)
    assert got == brute(rows) and [r[3] for r in got if r[1] == "a" and r[2] == "term"] == ["blue", "green"]


def test_large_counts_do_not_overflow(spark):
    rows = [("en", "a", "word " * 400_000 + "other")] + [("en", "b", "word other thing")] * 3 + [("en", "a", "thing")]
    assert found(spark, rows) == brute(rows)
    share = lambda c, n: spark.range(1).selectExpr(divergence._share(f"{c}L", f"{n}L")).first()[0]
    assert share(9 * 10**15, 10**16) == 1 + 10**9 * (9 * 10**15 + 1) // 10**16


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("name", ["op12_divergence_vectors", "op13_bitmap_interactions"])
def test_query_against_its_sql(spark, name):
    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    cur = duck.execute(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
