r"""How the word counts of sources diverge, evaluated once a distinct count vector.

Terms are runs of letters (A-Z, a-z and every code point from U+0080), A-Z lower-cased. A language keeps the terms that at least
SUPPORT of its documents have. A term's vector is its sparse counts by source; terms of one language with the same vector give
the same terms of every sum, so vectors are grouped and each is evaluated once, times the number of its terms. Smoothed shares are
whole numbers, p = 1 + floor(UNIT * (count + 1) / (N + V)), and a divergence is the sum of f = floor((p - q)^2 / q).

Of a pair (a, b) of sources, most vectors have no count in one or both. With a0 for the share of an absent term, the sum over all
terms splits exactly into
    V f(a0, b0)
    + sum over counts of a:  M(a, c) (f(pa, b0) - f(a0, b0)), and the same for b, M the number of terms with that count
    + sum over vectors that have both:  m (f(pa, pb) - f(pa, b0) - f(a0, pb) + f(a0, b0)),
so a vector is opened only to the pairs of sources it has, and no vector is spread over all sources.

Words are counted inside each document and added up in the task before they are shuffled; denominators reach the vectors by a join on
language and a salt, so a language with most of the rows is spread. The 200 best terms of a group are found by row numbers
that Spark limits in every partition.

Defined cases: null text, lang and source are ''; every row counts as a document, repeated ones too; a group without terms has N = 0
and takes part in all pairs; a language without kept terms has value 0 in every pair; ties go by UTF-8 order of the item; doc_id isn't
read; an empty table gives an empty table; other columns are ignored. Sums are 64-bit and raise an error when they overflow.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

SUPPORT, UNIT, TOP = 3, 1_000_000_000, 200
#: Distinct (lang, source, term) that a task holds, and parts of a language's vectors.
HELD, SALTS = 200_000, 64
#: Bytes of terms, A-Z lower-cased; all others become spaces. Bytes from 0x80 on belong to code points from U+0080.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, source, term, n, docs of a task's documents; term '' stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> pd.DataFrame:
        out = []
        for (lang, source), (n, docs) in groups.items():
            out.append(pd.DataFrame({"lang": lang, "source": source, "term": ["", *map(bytes.decode, n)], "n": [0, *n.values()], "docs": [0, *map(docs.get, n)]}))
        return pd.concat(out, ignore_index=True)

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            words, before = terms(text), len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n) - before + 1
            if held > HELD:
                yield rows()
                groups, held = {}, 0
    if groups:
        yield rows()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) of every group, and a row with term '' a group."""
    told = small_batches(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]))
    found = told.mapInPandas(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, whole: str) -> str:
    """1 + floor(UNIT * (count + 1) / whole) for any longs: div of decimals is a whole number, without rounding."""
    return f"1 + (cast({count} + 1 as decimal(20,0)) * {UNIT}) div cast({whole} as decimal(20,0))"


def _f(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _with(rows: DataFrame, langs: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their language; the rows of one language are dealt by a hash of `key`."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    each = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(each, ["lang", "_salt"]).drop("_salt")


def divergences(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language, and the terms that a source has most in excess."""
    found = written(counts(docs), "counts")
    groups = found.where("term = ''").select("lang", "source")
    vectors = found.where("term <> ''").groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs")
    )
    vectors = written(vectors.where(F.col("docs") >= support).drop("docs"), "vectors")
    entry = vectors.select("lang", F.explode("vector").alias("e")).select("lang", "e.source", "e.n")
    sums = groups.join(entry.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"))
    totals = sums.withColumn("n", F.coalesce("n", F.lit(0))).join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    # one row a language: the denominators of its sources, and its own
    langs = totals.groupBy("lang", "v").agg(F.map_from_entries(F.collect_list(F.struct("source", F.col("n") + F.col("v")))).alias("whole"), (F.sum("n") + F.col("v")).alias("all_"))
    langs = written(langs, "langs")

    shapes = vectors.groupBy("lang", "vector").agg(F.count("*").alias("m"))
    shapes = written(
        _with(shapes, langs.select("lang", "whole"), "vector").select(
            "lang", "m", F.expr(f"transform(vector, e -> named_struct('s', e.source, 'n', e.n, 'p', {_share('e.n', 'whole[e.source]')}, 'zero', {_share('0L', 'whole[e.source]')}))").alias("own")
        ),
        "shapes",
    )
    both = shapes.select("lang", "m", "own", F.explode("own").alias("a")).select("lang", "m", "a", F.explode("own").alias("b")).where("a.s <> b.s")
    both = both.select(
        "lang", F.col("a.s").alias("source"), F.col("b.s").alias("item"),
        F.expr(f"m * ({_f('a.p', 'b.p')} - {_f('a.p', 'b.zero')} - {_f('a.zero', 'b.p')} + {_f('a.zero', 'b.zero')})").alias("value"),
    )
    single = shapes.select("lang", "m", F.explode("own").alias("a")).groupBy("lang", F.col("a.s").alias("s"), F.col("a.p").alias("p"), F.col("a.zero").alias("zero")).agg(F.sum("m").alias("m"))
    single = _with(single, langs.select("lang", "whole"), "p").select("lang", "s", "p", "zero", "m", F.explode("whole").alias("o", "w"))
    single = single.where("s <> o").select("lang", "s", "p", "zero", "m", "o", F.expr(_share("0L", "w")).alias("other"))
    ahead = single.select("lang", F.col("s").alias("source"), F.col("o").alias("item"), F.expr(f"m * ({_f('p', 'other')} - {_f('zero', 'other')})").alias("value"))
    behind = single.select("lang", F.col("o").alias("source"), F.col("s").alias("item"), F.expr(f"m * ({_f('other', 'p')} - {_f('other', 'zero')})").alias("value"))
    absent = langs.select("lang", "v", "whole", F.explode("whole").alias("source", "w")).select("lang", "v", "source", "w", F.explode("whole").alias("item", "x")).where("source <> item")
    absent = absent.select("lang", "source", "item", F.expr(f"if(v = 0, 0L, v * ({_f(_share('0L', 'nullif(w, 0)'), _share('0L', 'nullif(x, 0)'))}))").alias("value"))
    parts = both.unionByName(ahead).unionByName(behind).unionByName(absent)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    words = _with(vectors, langs.select("lang", "whole", "all_"), "term")
    words = words.withColumn("q", F.expr(_share("aggregate(vector, 0L, (t, e) -> t + e.n)", "all_")))
    words = words.select("lang", "term", "q", "whole", F.explode("vector").alias("e"))
    words = words.select("lang", F.col("e.source").alias("source"), F.col("term").alias("item"), "q", F.expr(_share("e.n", "whole[e.source]")).alias("p"))
    words = words.where("p > q").select("lang", "source", "item", F.expr(_f("p", "q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    told = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told(pairs, "pair").unionByName(told(words, "term"))


ORACLE_SQL = r"""
with texts as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
),
words as (select row, lang, source, unnest(w) as term from texts),
kept as (select lang, term from words group by lang, term having count(distinct row) >= 3),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from texts),
counted as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join counted c using (lang, source, term)),
shares as (
    select g.lang, g.source, g.term, g.n, 1 + (1000000000::hugeint * (g.n + 1)) // (sum(g.n) over (partition by g.lang, g.source) + s.v) as p
    from grid g join sizes s using (lang)
),
whole as (
    select t.lang, t.term, 1 + (1000000000::hugeint * (t.n + 1)) // (sum(t.n) over (partition by t.lang) + s.v) as q
    from (select lang, term, sum(n) as n from grid group by all) t join sizes s using (lang)
),
pairs as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
every as (
    select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
),
terms as (
    select s.lang, s.source, s.term as item, ((s.p - w.q) * (s.p - w.q)) // w.q as value
    from shares s join whole w using (lang, term) where s.n > 0 and s.p > w.q
),
ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from every
    union all
    select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""
