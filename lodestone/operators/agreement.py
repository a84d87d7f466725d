"""Agreement between raters and sets: Jaccard, precision and recall, Cohen's and Fleiss' kappa, Krippendorff's alpha."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairwise_jaccard(df: DataFrame, rater: str, item: str) -> DataFrame:
    """(a, b, jaccard) of every pair of raters, from the sizes of their item sets and of what two share.

    Items are first reduced to the set of their raters; equal sets are counted, so the pairs come from the few distinct sets.
    """
    sets = df.select(rater, item).distinct().groupBy(item).agg(F.array_sort(F.collect_set(rater)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    size = sets.select(F.explode("s").alias("r"), "n").groupBy("r").agg(F.sum("n").alias("size"))
    both = sets.select(F.explode("s").alias("a"), "s", "n").select("a", F.explode("s").alias("b"), "n").where("a < b").groupBy("a", "b").agg(F.sum("n").alias("both"))
    pairs = size.select(F.col("r").alias("a"), F.col("size").alias("na")).join(size.select(F.col("r").alias("b"), F.col("size").alias("nb")), F.col("a") < F.col("b"))
    joined = pairs.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return joined.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"))


def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of two sets of keys."""
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(True))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    n = t.join(f, keys, "full_outer").agg(
        F.count_if(F.col("_t") & F.col("_f")).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn")
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp = F.col("tp")
    return n.select("tp", "fp", "fn", ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"), ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def cohen(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: items and kappa of two label columns; rows without both labels do not count."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    seen = cells.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    both = seen.join(chance, F.lit(True))
    po, pe = F.col("same") / F.col("items"), F.col("e") / (F.col("items").cast("double") * F.col("items"))
    return both.select("items", F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def fleiss(df: DataFrame, item: str, rater: str, label: str, raters: int) -> DataFrame:
    """One row: items and kappa over the items that all `raters` have labelled."""
    cells = df.where(F.col(label).isNotNull()).groupBy(item, F.col(label).alias("l")).agg(F.count_distinct(rater).alias("n"))
    per = cells.groupBy(F.col(item).alias("_i")).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where(F.col("m") == raters)
    agree = per.agg(F.count("*").alias("items"), F.avg((F.col("sq") - raters) / (raters * (raters - 1))).alias("p"))
    shares = cells.join(per.select("_i"), F.col(item) == F.col("_i"), "left_semi").groupBy("l").agg(F.sum("n").alias("n"))
    chance = shares.agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("e"))
    return agree.join(chance, F.lit(True)).select("items", F.round(F.try_divide(F.col("p") - F.col("e"), 1 - F.col("e")), 6).alias("kappa"))


def alpha(df: DataFrame, item: str, value: str, interval: bool = False) -> DataFrame:
    """One row: pairable values and Krippendorff's alpha, nominal or interval; missing labels allowed.

    Disagreement comes from counts (nominal) or from sums of values and squares (interval), never from pairs of rows.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(item).alias("i"), F.col(value).alias("v"))
    m = v.groupBy("i").agg(F.count("*").alias("m")).where("m > 1")
    if interval:
        x = F.col("v").cast("double")
        per = v.groupBy("i").agg(F.count("*").cast("double").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m > 1")
        t = per.agg(F.sum("m").alias("n"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        do, de = F.col("o") / F.col("n"), 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
        return t.select(F.col("n").cast("long").alias("values"), F.round(1 - F.try_divide(do, de), 6).alias("alpha"))
    cells = v.join(m, "i").groupBy("i", "v", "m").agg(F.count("*").cast("double").alias("c"))
    o = cells.agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("o"))
    n = cells.groupBy("v").agg(F.sum("c").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    t = o.join(n, F.lit(True))
    de = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))
    return t.select(F.col("n").cast("long").alias("values"), F.round(1 - F.try_divide(F.col("o") / F.col("n"), de), 6).alias("alpha"))


#: Items below which an interval says nothing, labels whose weights a task holds.
FEW_ITEMS, LABELS = 5, 1024


def _weights(key: tuple, items: int, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws the `items` items of one profile: Poisson, from a hash of the profile."""
    spread = int.from_bytes(repr(key).encode(), "little")
    return np.random.default_rng([seed, spread]).poisson(items, replicates)


def alpha_interval(df: DataFrame, item: str, value: str, interval: bool = False, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """One row: items, values, alpha, and the 2.5 and 97.5 percentiles (low, high) of alpha over items drawn with replacement.

    alpha is no mean, so replicates need each item's part in observed and expected disagreement. Items with the same labels (nominal) or the same
    count, sum and squares (interval) are one profile; a replicate draws a profile's items a Poisson number of times, the same whatever the partitions, and
    is a row of sums. Nominal replicates are summed by label first. Items with one label don't count; below FEW_ITEMS items the interval is NaN,
    as it is where no replicate has a value.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(item).alias("i"), F.col(value).alias("v"))
    if interval:
        x = F.col("v").cast("double")
        per = v.groupBy("i").agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m > 1")
        cells = per.groupBy("m", "s", "q").agg(F.count("*").alias("items"))

        def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, o, s, q = np.zeros((4, replicates))
            for part in parts:
                for m, a, b, items in part[["m", "s", "q", "items"]].itertuples(index=False):
                    w = _weights((m, a, b), items, replicates, seed)
                    n, o, s, q = n + w * m, o + w * 2 * (m * b - a * a) / (m - 1), s + w * a, q + w * b
            yield pd.DataFrame({"rep": np.arange(replicates), "n": n, "o": o, "s": s, "q": q})

        sums = cells.mapInPandas(draw, "rep int, n double, o double, s double, q double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in "nosq"])
        expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    else:
        counts = v.groupBy("i", "v").agg(F.count("*").alias("c"))
        per = counts.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(F.col("v").cast("string").alias("v"), "c"))).alias("p"), F.sum("c").alias("m")).where("m > 1")
        cells = per.groupBy("p", "m").agg(F.count("*").alias("items"))

        def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows (label, rep, n), and (null, rep, o)."""
            o, of = np.zeros(replicates), {}
            rows = lambda label, x: pd.DataFrame({"label": label, "rep": np.arange(replicates), "x": x})
            for part in parts:
                for p, m, items in part[["p", "m", "items"]].itertuples(index=False):
                    w = _weights(tuple((x["v"], x["c"]) for x in p), items, replicates, seed)
                    o += w * sum(x["c"] * (m - x["c"]) for x in p) / (m - 1)
                    for x in p:
                        of[x["v"]] = of.get(x["v"], 0) + w * float(x["c"])
                    if len(of) > LABELS:
                        yield from (rows(label, n) for label, n in of.items())
                        of = {}
            yield from (rows(label, n) for label, n in of.items())
            yield rows(None, o)

        sums = cells.mapInPandas(draw, "label string, rep int, x double").groupBy("rep", "label").agg(F.sum("x").alias("x"))
        labelled = F.col("label").isNotNull()
        sums = sums.groupBy("rep").agg(
            F.sum(F.when(labelled, F.col("x"))).alias("n"), F.sum(F.when(labelled, F.col("x") * F.col("x"))).alias("sq"), F.sum(F.when(~labelled, F.col("x"))).alias("o")
        )
        expected = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))
    drawn = sums.where("n > 1").select((1 - F.try_divide(F.col("o") / F.col("n"), expected)).alias("a"))
    ends = drawn.agg(*[F.percentile("a", F.lit(p)).alias(name) for name, p in (("low", 0.025), ("high", 0.975))])
    some = F.coalesce("items", F.lit(0)) >= FEW_ITEMS
    end = lambda c: F.when(some, F.coalesce(F.round(c, 6), F.lit(float("nan")))).otherwise(float("nan")).alias(c)
    one = alpha(df, item, value, interval).join(cells.agg(F.sum("items").alias("items")), F.lit(True)).join(ends, F.lit(True))
    return one.select(F.coalesce("items", F.lit(0)).alias("items"), "values", "alpha", end("low"), end("high"))


def set_alpha(df: DataFrame, rater: str, paper: str, item: str, raters: int, by: list[str] | None = None, replicates: int = 0, seed: int = 42) -> DataFrame:
    """(by..., papers, items, alpha, and with replicates low and high) of raters that each name a set of items a paper.

    A paper counts that all `raters` have looked at; a rater that found nothing has a row with a null item. Its items are the union of what they name, each
    labelled by every rater as named or not, so an item is told by the number of raters that name it, and alpha, and its replicates too, by the counts of those
    numbers. With runs as raters and models in `by` it is the agreement of a model with itself.
    """
    by = by or []
    seen = df.select(*by, paper, rater, item).distinct()
    whole = seen.groupBy(*by, paper).agg(F.count_distinct(rater).alias("_r")).where(F.col("_r") == raters).drop("_r")
    keys = [*by, paper]
    named = seen.where(F.col(item).isNotNull()).join(whole, keys, "left_semi").groupBy(*keys, item).agg(F.count("*").alias("k"))
    cells = named.groupBy(*by, "k").agg(F.count("*").alias("items"))
    n, k = F.col("items") * F.lit(float(raters)), F.col("k") * F.col("items").cast("double")
    sums = [F.sum("items").alias("items"), F.sum(n).alias("n"), F.sum(k).alias("one"), F.sum(2 * F.col("k") * (raters - F.col("k")) / (raters - 1.0) * F.col("items")).alias("o")]
    zero = F.col("n") - F.col("one")
    expected = (F.col("n") * F.col("n") - F.col("one") * F.col("one") - zero * zero) / (F.col("n") * (F.col("n") - 1))
    value = 1 - F.try_divide(F.col("o") / F.col("n"), expected)
    out = whole.groupBy(*by).agg(F.count("*").alias("papers"))
    join = lambda a, b: a.join(b, by, "left") if by else a.join(b, F.lit(True), "left")
    out = join(out, cells.groupBy(*by).agg(*sums).select(*by, "items", F.round(value, 6).alias("alpha"))).fillna({"items": 0})
    if not replicates:
        return out

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                w = _weights((*map(str, row[: len(by)]), row.k), row.items_, replicates, seed)
                yield pd.DataFrame({**{c: [x] * replicates for c, x in zip(by, row)}, "k": row.k, "rep": np.arange(replicates), "items": w})

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    drawn = cells.withColumnRenamed("items", "items_").select(*by, "k", "items_").mapInPandas(draw, f"{kinds}k long, rep int, items long")
    drawn = drawn.groupBy(*by, "rep").agg(*sums).where("n > 1").select(*by, value.alias("a"))
    ends = drawn.groupBy(*by).agg(*[F.percentile("a", F.lit(p)).alias(name) for name, p in (("low", 0.025), ("high", 0.975))])
    end = lambda c: F.when(F.col("items") >= FEW_ITEMS, F.coalesce(F.round(c, 6), F.lit(float("nan")))).otherwise(float("nan")).alias(c)
    return join(out, ends).select(*by, "papers", "items", "alpha", end("low"), end("high"))


def run_stability(df: DataFrame, model: str, paper: str, run: str, item: str) -> DataFrame:
    """(model, papers, stable, distinct, mean_outputs, pairs, identical, count_diff, median_dn) of repeated runs of each model.

    A paper counts with every run that has it. stable: papers whose runs all gave one set of items; distinct: whose runs all differ. pairs: pairs
    of runs of a paper, of which `identical` gave the same set and `count_diff` differ in its size; median_dn: the median of those size differences.
    Runs are reduced to (set, runs that gave it) a paper, and size differences to counts, so pairs of runs are never listed.
    """
    sets = df.groupBy(model, paper, run).agg(F.array_sort(F.collect_set(item)).alias("s"))
    kinds = sets.groupBy(model, paper, "s").agg(F.count("*").alias("c"))
    sizes = kinds.groupBy(model, paper, F.size("s").alias("z")).agg(F.sum("c").alias("c"))
    per = kinds.groupBy(model, paper).agg(F.sum("c").alias("runs"), F.count("*").alias("kinds"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    own = sizes.groupBy(model, paper).agg(F.collect_list(F.struct("z", "c")).alias("all"))  # at most as many sizes as runs
    gaps = own.select(model, F.explode("all").alias("a"), "all").select(model, "a", F.explode("all").alias("b")).where("b.z > a.z")
    gaps = gaps.groupBy(model, (F.col("b.z") - F.col("a.z")).alias("d")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("c"))
    w = Window.partitionBy(model)
    ranked = gaps.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("d"))})
    middle = ranked.where((F.col("upto") * 2 >= F.col("n")) & ((F.col("upto") - F.col("c")) * 2 <= F.col("n")))
    moved = middle.groupBy(F.col(model).alias("_m")).agg(((F.min("d") + F.max("d")) / 2).alias("median_dn"), F.max("n").alias("count_diff"))
    out = per.groupBy(model).agg(
        F.count("*").alias("papers"), F.count_if(F.col("kinds") == 1).alias("stable"), F.count_if((F.col("kinds") == F.col("runs")) & (F.col("runs") > 1)).alias("distinct"),
        F.round(F.avg("kinds"), 6).alias("mean_outputs"), F.sum(F.col("runs") * (F.col("runs") - 1) / 2).cast("long").alias("pairs"), F.sum("same").cast("long").alias("identical"),
    )
    return out.join(moved, F.col(model) == F.col("_m"), "left").drop("_m").fillna({"count_diff": 0, "median_dn": 0.0})


def value_agreement(truth: DataFrame, found: DataFrame, keys: list[str], value: str, near: float = 2.0) -> DataFrame:
    """One row: keys that both have with a value, and how many of the values differ by no more than `near`."""
    t, f = (d.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias(name)) for d, name in ((truth, "_t"), (found, "_f")))
    both = t.join(f, keys)
    return both.agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("_t") - F.col("_f")) <= near).alias("close")).withColumn("rate", F.round(F.try_divide("close", "compared"), 6))
