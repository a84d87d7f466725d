r"""Audit of how filters interact, from a packed bitmap index.

Every document gets one bit a filter: A under 100 words, B fewer than 80 distinct of 100 words, C more than 10 of 100 code points in
A-Z, D one of # $ % & * |, E the text of a smaller doc_id. Inside a task the rows of a batch are laid out part by part, and each
filter, each label and each part is a packed bitset over them. For each set of filters applied before (a prefix subset, 32 of them) and
each filter after it, the survivors, the removed and the redundant are AND-NOT of those bitsets, counted by popcount; an order of the
filters is a path through these 80 steps, so 120 orders need no more. Tasks add their counts over batches, Spark adds those of the tasks.

E needs one shuffle of digests: the least doc_id of each text that occurs more than once is joined back (Spark may split a text that
many rows have), so no task holds a group of copies.

Defined cases: null text is empty; null lang is the part ''; a null doc_id has nothing smaller and is smaller than nothing, so its text is
never a copy of its own; rows that repeat a doc_id and a text are no copies of each other; a text without a word fails A and not
B; labels count as 1 if any row of the doc_id says 1, documents without a label as neither; an empty table gives an empty table; other
columns are ignored. Texts are told apart by SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, whole_text, written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts whose counts a task holds before it passes them on.
HELD = 1024


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the whole text, mask: bit k is set if filter k of ABCD fails. One pass over the texts."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("t"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    fails = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * F.regexp_count("t", F.lit("[A-Z]")) > UPPER_PERCENT * F.char_length("t"),
        F.col("t").rlike(SYMBOLS),
    )
    mask = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    return docs.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def indexed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails filter k of ABCDE), good, toxic of every document."""
    rows = written(facts(docs), "facts")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copied = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    none = F.lit(0)
    return rows.join(first, "digest", "left").join(marks, "doc_id", "left").select(
        "part", (F.col("mask") + copied).alias("mask"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")
    )


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags.astype(bool), bitorder="little")


def steps(part: np.ndarray, fails: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """(32, 5, 6) counts of COUNTS: for each prefix subset and each filter outside it, from the bitsets of one part."""
    n = lambda bits: int(np.bitwise_count(bits).sum())
    gone = [np.zeros_like(part)]
    for subset in range(1, 32):
        low = (subset & -subset).bit_length() - 1
        gone.append(gone[subset & subset - 1] | fails[low])
    out = np.zeros((32, len(FILTERS), len(COUNTS)), np.int64)
    for k, fail in enumerate(fails):
        failing = part & fail
        alone = n(failing & ~gone[31 & ~(1 << k)])
        for subset in range(32):
            if subset >> k & 1:
                continue
            here = failing & ~gone[subset]
            out[subset, k] = n(part & ~gone[subset | 1 << k]), n(here), n(failing & gone[subset]), alone, n(here & good), n(here & toxic)
    return out


def _rows(held: dict[str, np.ndarray]) -> pd.DataFrame:
    at = [(s, k) for s in range(32) for k in range(len(FILTERS)) if not s >> k & 1]
    s, k = np.array(at).T
    frames = [pd.DataFrame({"part": part, "prefix": s, "filter": k} | {c: counts[s, k, i] for i, c in enumerate(COUNTS)}) for part, counts in held.items()]
    return pd.concat(frames, ignore_index=True)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        codes, names = pd.factorize(batch["part"])
        order = np.argsort(codes, kind="stable")
        mask = batch["mask"].to_numpy(np.int64)[order]
        fails = [_bits(mask >> k & 1) for k in range(len(FILTERS))]
        good, toxic = (_bits(batch[c].to_numpy(np.int64)[order]) for c in ("good", "toxic"))
        ends = np.cumsum(np.bincount(codes, minlength=len(names)))
        for name, low, high in zip(names, [0, *ends[:-1].tolist()], ends.tolist()):
            a, b = low // 8, (high + 7) // 8  # the bytes that hold the part's rows
            own = np.zeros((b - a) * 8, bool)
            own[low - a * 8 : high - a * 8] = True
            found = steps(_bits(own), [f[a:b] for f in fails], good[a:b], toxic[a:b])
            held[name] = held[name] + found if name in held else found
        if len(held) > HELD:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def tallies(rows: DataFrame) -> DataFrame:
    """part, prefix (bit k: filter k was applied before), filter (its number), and COUNTS, from rows of part, mask, good, toxic."""
    schema = "part string, prefix int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInPandas(_tally, schema).groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS, shapley: a row a part, order of the filters and step of it."""
    spark, n = docs.sparkSession, len(FILTERS)
    counted = written(tallies(indexed(docs, labels)), "tallies")
    # of the orders, |prefix|! (n - 1 - |prefix|)! have just this prefix before the filter
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("prefix") + 1)
    shapley = counted.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    paths = [
        ("".join(order), step + 1, sum(1 << FILTERS.index(x) for x in order[:step]), FILTERS.index(order[step])) for order in permutations(FILTERS) for step in range(n)
    ]
    walk = spark.createDataFrame(paths, "filter_order string, step int, prefix int, filter int")  # 600 rows, whatever the table
    return counted.join(F.broadcast(walk), ["prefix", "filter"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE_SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from texts),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
failing as (
    select words.part,
        (case when len(w) < 100 then 'A' else '' end)
        || (case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end)
        || (case when 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end)
        || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
        || (case when words.doc_id > first then 'E' else '' end) as f,
        coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
    from words left join marks using (doc_id)
),
kinds as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from failing group by part, f),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
walk as (
    select filter_order, step::int as step, filter_order[step] as x, case when step = 1 then '-' else filter_order[1:step - 1] end as before
    from orders, range(1, 6) s(step)
),
counts as (
    select part, filter_order, step, x,
        sum(case when not regexp_matches(f, '[' || replace(before, '-', '') || x || ']') then n else 0 end) as kept,
        sum(case when contains(f, x) and not regexp_matches(f, '[' || before || ']') then n else 0 end) as removed,
        sum(case when contains(f, x) and regexp_matches(f, '[' || before || ']') then n else 0 end) as redundant,
        sum(case when f = x then n else 0 end) as unique_fails,
        sum(case when contains(f, x) and not regexp_matches(f, '[' || before || ']') then good else 0 end) as good_lost,
        sum(case when contains(f, x) and not regexp_matches(f, '[' || before || ']') then toxic else 0 end) as toxic_lost
    from kinds, walk group by all
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
    unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, x))::bigint as shapley
from counts
"""
