"""Table shapes: top-k, keep-first, latest, paging, upsert, snapshot diff, samples, parent links, stacked metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; groups are cut to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def keep_best(df: DataFrame, keys: list[str], confidence: str, *ties: Column) -> DataFrame:
    """The row of most confidence of each key, null counting as -1."""
    return keep_first(df, keys, [F.coalesce(F.col(confidence), F.lit(-1.0)).desc(), *ties])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, in one aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def spread(df: DataFrame, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """df by the hash of its keys in parts of about `rows` rows, however narrow they are: parts that are cut by bytes hold more rows than a task's maps should.

    Its rows are counted first, so it is for tables whose files know their number.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))
    return df.repartition(parts, *keys)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """source rows replace target rows of the same key in the columns `update` (all by default), new keys are added."""
    rest = [c for c in target.columns if c not in keys]
    update = rest if update is None else update
    s = source.select(*keys, F.struct(*[c for c in rest if c in source.columns]).alias("_s"))
    both = target.select(*keys, F.struct(*rest).alias("_t")).join(s, keys, "full_outer")
    new = lambda c: F.col(f"_s.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
    col = lambda c: F.when(F.col("_s").isNull(), F.col(f"_t.{c}")).when(F.col("_t").isNull() | F.lit(c in update), new(c)).otherwise(F.col(f"_t.{c}"))
    return both.select(*keys, *[col(c).alias(c) for c in rest])


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that `fresh` brings are replaced."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def guarded_insert(existing: DataFrame, wanted: DataFrame, targets: DataFrame, keys: list[str], target: str) -> DataFrame:
    """wanted with `status`: 201 where it is new and its target exists, 409 if it is there already, 404 without a target."""
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    there = targets.select(target).distinct().withColumn("_there", F.lit(True))
    joined = wanted.join(there, target, "left").join(have, keys, "left")
    return joined.withColumn("status", F.when(F.col("_there").isNull(), 404).when(F.col("_have"), 409).otherwise(201)).drop("_have", "_there")


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, side (added, removed, changed, same) and the names of changed columns, null equal to null."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in values]))
    side = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(*keys, side.alias("side"), F.when(side == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of the key: the same ones whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, least: int = 15, tenth: int = 10, seed: int = 42) -> DataFrame:
    """From each stratum the larger of `least` rows and one in `tenth`."""
    w = Window.partitionBy(stratum)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return df.withColumns({"_n": n, "_rank": rank}).where(F.col("_rank") <= F.greatest(F.lit(least), F.floor(F.col("_n") / tenth))).drop("_n", "_rank")


def stack_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value): all aggregates in one pass over df."""
    one = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])
    return one.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def share(df: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """Count and percentage of each group; the total is a row of its own."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    joined = counts.join(df.agg(F.count("*").alias("_all")), F.lit(True))
    return joined.withColumn("pct", F.round(100.0 * F.col("n") / F.col("_all"), digits)).drop("_all")


def merge_records(df: DataFrame, key: str, records: str, identity) -> DataFrame:
    """(key, records): nested records of all rows of a key, one a set of identity(record) columns, the first by order of `ord`."""
    flat = df.select(key, "ord", F.posexplode(records).alias("_p", "_r"))
    flat = flat.withColumn("_i", F.struct(*identity(F.col("_r"))))
    kept = flat.groupBy(key, "_i").agg(F.min_by("_r", F.struct("ord", "_p")).alias("_r"), F.min(F.struct("ord", "_p")).alias("_o"))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "_r"))).alias("_all")).select(key, F.col("_all._r").alias(records))


def versioned(df: DataFrame, stamp: str) -> DataFrame:
    """One row: the version name of the latest stamp."""
    return df.agg(F.date_format(F.max(stamp), "'v'yyyy.MM.dd").alias("version"))


def rewrite_records(records: Column, **fields) -> Column:
    """The array of records with fields replaced by functions of the record, in the same order."""
    def one(r: Column) -> Column:
        for name, f in fields.items():
            r = r.withField(name, f(r))
        return r

    return F.transform(records, one)


def keep_records(records: Column, keep) -> Column:
    """The records for which keep holds, in the same order; a condition without an answer does not drop a record."""
    return F.filter(records, lambda r: F.coalesce(keep(r), F.lit(True)))


def reordered(hits: DataFrame, by: str, missing, rank: str = "rank") -> DataFrame:
    """A short list of hits by another column descending, `missing` where it is null; equal ones keep their rank."""
    return hits.orderBy(F.coalesce(F.col(by), F.lit(missing).cast(hits.schema[by].dataType)).desc(), rank)


def fidelity(fresh: DataFrame, old: DataFrame, key: str, fields: list[str], near: float = 0.05) -> DataFrame:
    """(metric, value): how two runs of an aggregation agree: rows of each, of both, and of one only; per field the rows that match (numbers
    within `near`, null equal to null)."""
    a, b = fresh.select(key, F.struct(*fields).alias("_a")), old.select(key, F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full_outer")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def same(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= near, F.lit(False)) if fresh.schema[c].dataType.simpleString() in ("double", "float") else x.eqNullSafe(y)

    metrics = {"fresh_rows": F.count("_a"), "old_rows": F.count("_b"), "in_both": F.count_if(shared), "orphans": F.count_if(F.col("_a").isNull()), "fresh_only": F.count_if(F.col("_b").isNull())}
    return stack_metrics(both, metrics | {f"match_{c}": F.count_if(shared & same(c)) for c in fields})


def movers(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str], k: int = 10) -> DataFrame:
    """(metric, rank, keys, old, new, delta, percent): of each metric the k keys that both snapshots have whose value has moved most, up or down.

    Ties go by the keys; nulls do not move; percent is null where the old value is 0. Each partition keeps its k rows of a metric before the shuffle.
    """
    pairs = lambda df: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m"))
    a = pairs(old).select(*keys, F.col("_m.metric").alias("metric"), F.col("_m.v").alias("old"))
    b = pairs(new).select(*keys, F.col("_m.metric").alias("metric"), F.col("_m.v").alias("new"))
    both = a.join(b, [*keys, "metric"]).withColumn("delta", F.round(F.col("new") - F.col("old"), 6)).where("delta <> 0")
    both = both.withColumn("percent", F.round(100 * F.try_divide(F.col("delta"), F.abs("old")), 2))
    return top_k(both, ["metric"], [F.abs("delta").desc(), *map(F.col, keys)], k).select("metric", "rank", *keys, "old", "new", "delta", "percent")
