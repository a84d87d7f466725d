r"""Mixing sources to target weights by entropy balancing.

A document's rate is its tilt r = min(cap, prior * exp(b * z)), z = size / mean size of its source: the rates in [0, cap] closest
in entropy to the prior under one constraint a source, the words of the mix (the source's target). The convex dual, one b a
source, is solved for all sources at once by Newton steps on the logarithm of the words, held inside a bracket: a step that
would leave it, or does not halve the error, halves the bracket instead (doubles its open side). Each step sums words and
curvature over the distribution of sizes within each source (source, size, prior -> count), which is exact and far smaller than
the documents; sources stay rows of a table throughout. A source that does not get within NEAR of a target below its cap is an error.

Rates become copies from long to short: each cell of equal documents takes as many copies as bring the words taken so far
nearest to the sum of rates so far, so shorter documents make up for what longer ones missed, and a source ends about half its
shortest documents from its target. A cell's copies go to its documents by a hash of doc_id. Cells are cut to about CELL
documents by that hash, so a size or source that a third of all rows share is spread over many groups.

Defined cases: null text has size 0; null source is a source of its own and comes last; documents of size 0 take
0 words; a source without words has target 0; equal rows with equal doc_id are rounded one by one; null doc_id
takes part like any other; a prior of null or below 0 counts as 0; a source with a target whose words all have prior 0 is an error; an empty table gives an empty table; other columns pass
through `mix` untouched.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, free, written

#: Weights of the sources in code-point order, repeating; words of the mix over words given; most copies of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
CELL, STEPS, NEAR = 1024, 80, 1e-9


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size: the number of words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def _ranked(names: DataFrame) -> DataFrame:
    """names (source) with place, its number in code-point order from 0, null last; numbers are counted in each range, then added up."""
    ranges = written(names.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "names")
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranges.withColumn("_k", F.row_number().over(inside)).join(starts, "_range").select("source", (F.col("_k") - 1 + F.col("_first")).alias("place"))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """totals (source, source_size, ...) with target: shares by weight, none above cap times its source's size.

    The excess of sources that reach the cap is shared again among the others until none is above. One row a source.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    t = _same_source(totals, _ranked(totals.select("source"))).withColumns({"_w": w, "_most": F.col("source_size") * F.lit(float(cap))})
    t = written(t.drop("place"), "weighed")
    want, level = (t.agg(F.sum("source_size")).first()[0] or 0) * min(share, cap), 0.0
    while True:  # the level rises from round to round, and each round but the last adds a source to those at the cap
        full = F.col("_most") <= F.lit(level) * F.col("_w")
        spent, weight = t.agg(F.sum(F.when(full, F.col("_most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        before, level = level, (want - spent) / weight if weight else level
        if level <= before:
            break
    return t.withColumn("target", F.least("_most", F.lit(before) * F.col("_w"))).drop("_w", "_most")


def _same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null."""
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _tilt(cap: float):
    return F.least(F.lit(float(cap)), F.col("prior") * F.exp(F.col("b") * F.col("z")))


def _exact(x):
    """The sum of x, the same in any order of rows."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def solve(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """Dual variables (source, b) by bracketed Newton steps on all sources at once.

    cells: source, size, prior, n. goals: source, source_size, n_docs, target. Sources whose target is at the cap, or 0, are left out.
    """
    goals = goals.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap))
    goals = goals.withColumn("mean", F.col("source_size") / F.col("n_docs")).select("source", "mean", (F.col("target") / F.col("mean")).alias("docs"))
    base = _same_source(cells.where("size > 0 and prior > 0"), goals).withColumn("z", F.col("size") / F.col("mean"))
    base = written(base.select("source", "z", "prior", "n", "docs"), "cells")
    none = F.lit(None).cast("double")
    state = written(base.select("source").distinct().withColumns({"b": F.lit(0.0), "low": none, "high": none, "err": none}), "dual")
    if (bare := _same_source(goals, state.select("source"), "left_anti").first()) is not None:
        raise RuntimeError(f"source {bare['source']!r} has a target, but no document with words has a prior above 0")
    worst = None
    for _ in range(STEPS):
        r = _tilt(cap)
        sums = _same_source(base, state).groupBy("source", "b", "low", "high", "err", "docs").agg(
            _exact(F.col("n") * r * F.col("z")).alias("words"), _exact(F.when(r < cap, F.col("n") * r * F.col("z") * F.col("z")).otherwise(0.0)).alias("curve")
        )
        off = F.log(F.col("words") / F.col("docs"))
        sums = sums.withColumns({"off": F.coalesce(off, F.lit(-1e9)), "was": F.col("err")})
        sums = sums.withColumns({"low": F.when(F.col("off") < 0, F.col("b")).otherwise(F.col("low")), "high": F.when(F.col("off") > 0, F.col("b")).otherwise(F.col("high"))})
        newton = F.when(F.col("curve") > 0, F.col("b") - F.col("off") * F.col("words") / F.col("curve"))
        inside = (newton > F.coalesce("low", F.lit(-1e300))) & (newton < F.coalesce("high", F.lit(1e300)))
        better = F.col("was").isNull() | (F.abs("off") < 0.5 * F.col("was"))
        halved = F.when(F.col("low").isNull(), 2 * F.col("high") - 1).when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.col("off") == 0, F.col("b")).when(F.coalesce(inside & better, F.lit(False)), newton).otherwise(halved)
        reached, stuck = F.abs("off") < NEAR, (F.col("curve") == 0) & (F.col("off") < -NEAR)  # every document is at the cap
        after = written(sums.select("source", F.when(reached, F.col("b")).otherwise(step).alias("b"), "low", "high", F.abs("off").alias("err"), stuck.alias("stuck")), "dual")
        discard(state)
        state = after
        worst, hopeless = after.agg(F.max("err"), F.max("stuck")).first()
        if worst is None or worst < NEAR:
            return state.select("source", "b")
        if hopeless:
            break
    raise RuntimeError(f"entropy balancing did not settle: a source's words are off by a factor of exp({worst})")


def _copies(cells: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The cells of one source with all_, the copies each takes, from long to short documents."""
    cells = cells.sort_values(["size", "prior"], ascending=[False, True], kind="stable")
    wanted = taken = 0.0
    out = []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
        wanted += size * n * rate
        times = min(max(int((wanted - taken) / size + 0.5), 0), cap * n) if size else round(n * rate)
        taken += times * size
        out.append(times)
    return cells.assign(all_=out)[["source", "size", "prior", "n", "all_"]]


def copies(docs: DataFrame, key: str = "doc_id", prior: str | None = None, cap: int = CAP, ties: tuple[str, ...] = (), **aims) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row). ties: columns that order rows of one key."""
    weight = F.when(F.col(prior).cast("double") > 0, F.col(prior).cast("double")).otherwise(0.0) if prior else F.lit(1.0)
    docs = docs.withColumn("_prior", weight)
    cells = written(docs.groupBy("source", "size", F.col("_prior").alias("prior")).agg(F.count("*").alias("n")), "sizes")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = written(targets(totals, cap=cap, **aims), "goals")
    known = _same_source(_same_source(cells, goals), solve(cells, goals, cap), "left").withColumn("z", F.col("size") * F.col("n_docs") / F.col("source_size"))
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("target") >= F.col("source_size") * cap, F.lit(float(cap))).otherwise(F.coalesce(_tilt(cap), F.lit(0.0)))
    rated = known.select("source", "size", "prior", "n", rate.alias("rate"))
    shares = rated.groupBy("source").applyInPandas(lambda own: _copies(own, int(cap)), "source string, size long, prior double, n long, all_ long")
    shares = _same_source(shares, goals.select("source", "source_size", "target"))
    shares = written(shares.withColumn("parts", F.ceil(F.col("n") / CELL)).withColumnsRenamed({"source": "_s", "size": "_z", "prior": "_p"}), "shares")
    spread = F.xxhash64(key, F.lit("cell"))
    cell = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & F.col("_prior").eqNullSafe(F.col("_p"))
    placed = docs.join(shares, cell).withColumn("_part", F.pmod(spread, F.col("parts"))).drop("_s", "_z", "_p", "parts")
    inside = Window.partitionBy("source", "size", "_prior", "_part")
    placed = placed.withColumn("_k", F.row_number().over(inside.orderBy(F.xxhash64(key, F.lit("round")), key, *ties)))
    counts = placed.groupBy("source", "size", "_prior", "_part", "n", "all_").agg(F.count("*").alias("_own"))
    order = Window.partitionBy("source", "size", "_prior").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_own").over(order)
    upto = lambda x: F.floor(x.cast("decimal(20,0)") * F.col("all_") / F.col("n"))
    shares = counts.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_prior").alias("_p"), F.col("_part").alias("_q"), "_own", (upto(end) - upto(end - F.col("_own"))).cast("long").alias("_all")
    )
    out = placed.join(shares, cell & (F.col("_part") == F.col("_q")))
    each = F.floor(F.col("_all") / F.col("_own")) + F.when(F.col("_k") <= F.col("_all") % F.col("_own"), 1).otherwise(0)
    return out.withColumn("copies", F.least(each, F.lit(int(cap))).cast("long")).drop("_prior", "_part", "_k", "_s", "_z", "_p", "_q", "n", "all_", "_own", "_all")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = written(sized(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    return copies(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def mix(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it (not at all, once or twice), with the columns it came with.

    Every row has its own copies, also those that share a doc_id or have none. Rows get a number, written once with them; only
    (number, deal, content, source, size) goes through the balancing. deal is doc_id, or without one a hash of the row, so which
    rows are taken does not depend on the numbers.
    """
    id_, deal, content, times, each = (free(c, docs) for c in ("_mix_id", "_mix_deal", "_mix_content", "_mix_copies", "_mix_each"))
    told = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    docs, given = written(docs.withColumn(id_, F.monotonically_increasing_id()), "numbered"), docs.columns
    rows = sized(docs.select(id_, "doc_id", F.xxhash64(*told).alias(content), "source", "text")).drop("text")
    rows = written(rows.withColumn(deal, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col(content).cast("string")))).drop("doc_id"), "sized")
    taken = copies(rows, key=deal, ties=(content,)).select(id_, F.col("copies").alias(times))
    joined = docs.join(taken.where(F.col(times) > 0), id_)
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*[F.col(f"`{c}`") for c in given])
