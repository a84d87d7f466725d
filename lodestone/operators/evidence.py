"""Consensus over evidence records: quorum-supported maxima, weighted votes, ordered picks, dispute and dominance.

Every function takes a DataFrame with one row a record and the names of its columns, and returns one row an entity. Records
are combined before each shuffle where the rule allows it, and a second key (source, value) spreads large entities first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the consensus rules.
DEFAULT_WEIGHT, MIN_SHARE, AGREE, DISSENT, SPREAD, DOMINANT, MOST = 0.5, 0.6, 0.7, 0.2, 0.30, 0.75, 10


def weight(confidence: Column) -> Column:
    """Confidence clamped to 0..1, DEFAULT_WEIGHT where it is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double"))), F.lit(DEFAULT_WEIGHT))


def corroborated_max(df: DataFrame, entity: str, source: str, value: str, out: str = "value", support: str = "support") -> DataFrame:
    """(entity, out, support): the highest value that enough sources reach.

    A source counts with its largest positive value. Under 5 sources the largest value stands; else it takes
    max(2, min(MOST, n div 20)) sources that say at least as much.
    """
    each = df.where((F.col(value) > 0) & F.col(source).isNotNull()).groupBy(entity, source).agg(F.max(value).cast("double").alias("v"))
    levels = each.groupBy(entity, "v").agg(F.count("*").alias("c"))
    sizes = levels.groupBy(entity).agg(F.sum("c").alias("n"))
    down = Window.partitionBy(entity).orderBy(F.col("v").desc())  # MOST levels hold MOST sources: the others are dropped before the shuffle
    top = levels.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= MOST).withColumn("reach", F.sum("c").over(down))
    ranked = top.join(sizes.withColumnRenamed(entity, "_e"), F.col(entity) == F.col("_e"))
    need = F.when(F.col("n") < 5, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(MOST), F.floor(F.col("n") / 20))))
    found = ranked.where(F.col("reach") >= need).groupBy(entity).agg(F.max(F.struct("v", "reach", "n")).alias("m"))
    return found.select(
        entity, F.col("m.v").alias(out), F.when(F.col("m.n") < 5, F.col("m.n")).otherwise(F.col("m.reach")).cast("long").alias(support)
    )


def weighted_mode(df: DataFrame, entity: str, source: str, value: str, confidence: str | None, out: str = "winner", records: DataFrame | None = None) -> DataFrame:
    """(entity, out): the text with most weight if it holds MIN_SHARE of it, in its commonest spelling; null without a consensus.

    Entities of two or more records need two sources for the winner; a missing source is one voter. Ties go to the smaller text. One pass: rows
    become a row a spelling before the shuffle, with the least and the greatest hash of their sources, which differ when there are two. records: (entity, records),
    the number of each entity's records, where df leaves out those that say nothing.
    """
    w = weight(F.col(confidence)) if confidence else F.lit(1.0)
    said = F.trim(F.col(value).cast("string"))
    key = F.when((F.lower(said) != "") & (F.lower(said) != "unknown"), F.lower(said))
    rows = df.select(entity, F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("s"), key.alias("k"), said.alias("said"), w.alias("w"))
    spelled = rows.groupBy(entity, "k", "said").agg(F.count("*").alias("c"), F.sum("w").alias("w"), F.min("s").alias("low"), F.max("s").alias("high"))
    votes = spelled.groupBy(entity, "k").agg(
        F.max(F.struct("c", "said"))["said"].alias("said"), F.sum("c").alias("c"), F.sum("w").alias("w"), (F.min("low") < F.max("high")).alias("several")
    )
    top = votes.groupBy(entity).agg(
        F.sum("c").alias("records"),
        F.sum(F.when(F.col("k").isNotNull(), F.col("w"))).alias("total"),
        F.min(F.when(F.col("k").isNotNull(), F.struct((-F.round("w", 9)).alias("neg"), "k", "w", "several", "said"))).alias("top"),
    )
    if records is not None:
        top = top.drop("records").join(records.withColumnRenamed(entity, "_e"), F.col(entity) == F.col("_e"))
    fine = ((F.col("records") < 2) | F.col("top.several")) & ((F.col("total") <= 0) | (F.round(F.col("top.w") / F.col("total"), 9) >= MIN_SHARE))
    return top.select(entity, F.when(fine, F.col("top.said")).alias(out))


def weighted_flag(df: DataFrame, entity: str, flag: str, confidence: str | None, out: str = "flag") -> DataFrame:
    """(entity, out): true or false where that side has AGREE of the weight and the other less than DISSENT; else null."""
    return df.groupBy(entity).agg(agreed_flag(F.col(flag), F.col(confidence) if confidence else F.lit(1.0)).alias(out))


def agreed_flag(flag: Column, confidence: Column) -> Column:
    """Aggregate: weighted_flag of one column."""
    w = weight(confidence)
    t, f = (F.sum(F.when(side, w).otherwise(0.0)) for side in (flag, ~flag))
    share = lambda x: F.round(x / F.nullif(t + f, F.lit(0.0)), 9)
    return F.when((share(t) >= AGREE) & (share(f) < DISSENT), True).when((share(f) >= AGREE) & (share(t) < DISSENT), False)


def filled(value: str) -> Column:
    """value, empty text read as null."""
    return F.when(F.col(value).cast("string") != "", F.col(value))


def exact_median(df: DataFrame, entity: str, value: str, out: str = "median") -> DataFrame:
    """(entity, out): the median of the values that are there. Equal values are counted first; the middle is found in running counts,
    sorted on disk where an entity has many distinct values."""
    cells = df.where(F.col(value).isNotNull()).groupBy(entity, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    own = Window.partitionBy(entity)
    ranked = cells.withColumns({"upto": F.sum("c").over(own.orderBy("v")), "n": F.sum("c").over(own)})
    middle = ranked.where((F.col("upto") * 2 >= F.col("n")) & ((F.col("upto") - F.col("c")) * 2 <= F.col("n")))  # one value, or the two about the middle
    return middle.groupBy(entity).agg(((F.min("v") + F.max("v")) / 2).alias(out))


def first_filled(value: str, order: list[str]) -> Column:
    """Aggregate: the first filled value in the given total order."""
    v = filled(value)
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*order)))


def earliest_filled(value: str, year: str, order: list[str]) -> Column:
    """Aggregate: the filled value of the earliest year, ties by order; without any year, the first in order."""
    v = filled(value)
    dated = F.min_by(v, F.when(v.isNotNull() & F.col(year).isNotNull(), F.struct(year, *order)))
    return F.coalesce(dated, first_filled(value, order))


def spread_dispute(value: str, limit: float = SPREAD) -> Column:
    """Aggregate: two or more values whose range exceeds `limit` of the largest."""
    top = F.max(value)
    return F.coalesce((F.count(value) >= 2) & (top > 0) & ((top - F.min(value)) / top > limit), F.lit(False))


def dominance(cited: Column, theory: Column) -> Column:
    """Aggregate: cited_only, experimental, theoretical or mixed."""
    n_cited, n_theo, n_exp = F.count_if(cited), F.count_if(~cited & theory), F.count_if(~cited & ~theory)
    share = lambda n: n / F.nullif(n_exp + n_theo, F.lit(0))
    return (
        F.when(n_cited == F.count("*"), "cited_only")
        .when(share(n_exp) >= DOMINANT, "experimental")
        .when(share(n_theo) >= DOMINANT, "theoretical")
        .when((n_exp > 0) & (n_theo > 0), "mixed")
    )


def display_form(df: DataFrame, entity: str, shown: str, out: str = "shown") -> DataFrame:
    """(entity, out): the commonest spelling, then the shortest, then the smaller one."""
    counted = df.where(F.col(shown).isNotNull()).groupBy(entity, shown).agg(F.count("*").alias("c"))
    return counted.groupBy(entity).agg(F.min_by(shown, F.struct(-F.col("c"), F.char_length(shown), F.col(shown))).alias(out))


def majority(df: DataFrame, entity: str, value: str, out: str = "winner") -> DataFrame:
    """(entity, out): the value with most rows, ties to the smaller value; nulls do not vote."""
    counted = df.where(F.col(value).isNotNull()).groupBy(entity, value).agg(F.count("*").alias("c"))
    return counted.groupBy(entity).agg(F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias(out))
