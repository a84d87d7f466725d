"""Structured Streaming jobs: quotas by day, trailing sums, resumable ingest, retention, retry pools, alerts. Each has its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Quotas a day, tries before a job is dead, ratio of a good batch, days kept, failures before an alert.
QUOTA = {"guest": 3, "user": 999}
MOST_TRIES, GOOD_RATIO, KEEP_DAYS, ALERT_AFTER = 5, 0.66, 90, 3


def stamped(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with ts as a TIMESTAMP, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_counts(df: DataFrame, key: str, limit: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, key, used, remaining, over) by tumbling days; a stream drops rows later than the watermark, a batch has none."""
    rows = stamped(df, ts)
    rows = rows.withWatermark(ts, late) if df.isStreaming else rows
    n = rows.groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(0), F.lit(limit) - F.col("used"))
    return n.select(F.to_date("w.start").alias("day"), key, "used", left.alias("remaining"), (F.col("used") > limit).alias("over"))


def trailing_counts(df: DataFrame, key: str, days: int = 7, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(last_day, key, used): counts over every window of `days` days that slides by one day."""
    rows = stamped(df, ts)
    rows = rows.withWatermark(ts, late) if df.isStreaming else rows
    n = rows.groupBy(F.window(ts, f"{days} days", "1 day").alias("w"), key).agg(F.count("*").alias("used"))
    return n.select(F.date_sub(F.to_date("w.end"), 1).alias("last_day"), key, "used")


def once(df: DataFrame, key: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once: on a stream within the watermark, in a batch over all rows, the earliest one."""
    if df.isStreaming:
        return stamped(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_r")).select(key, "_r.*")


def retained(df: DataFrame, now: Column, days: int = KEEP_DAYS, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def good_batches(df: DataFrame, batch: str, ok: Column, least: float = GOOD_RATIO) -> DataFrame:
    """(batch, n, ok, good): a batch is good when enough of its rows are; batches without rows are none here and count as good."""
    n = df.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    return n.withColumn("good", F.col("ok") / F.col("n") >= least)


def alerts(df: DataFrame, key: str, failed: Column, order: list[str], after: int = ALERT_AFTER) -> DataFrame:
    """Rows at which a key has failed `after` times in a row; a success starts the count anew."""
    w = Window.partitionBy(key).orderBy(*order)
    run = df.withColumn("_f", failed).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(key, "_g").orderBy(*order)
    return run.where("_f").withColumn("streak", F.row_number().over(inside)).where(F.col("streak") == after).drop("_f", "_g")


STREAKS = "key string, streak int, alert boolean"


def _streaks(after: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (streak,) = state.get if state.exists else (0,)
        raised = False
        for failed in pd.concat(list(parts)).sort_values("order")["failed"]:
            streak = streak + 1 if failed else 0
            raised |= streak == after
        state.update((streak,))
        yield pd.DataFrame({"key": [key[0]], "streak": [streak], "alert": [raised]})

    return step


def streaks(results: DataFrame, after: int = ALERT_AFTER) -> DataFrame:
    """Results (key, failed, order) as a stream -> each key with news: its present run of failures, and whether it reached `after` just now.

    `alerts` is the batch twin: the rows at which a run reaches `after`.
    """
    return results.groupBy("key").applyInPandasWithState(_streaks(after), STREAKS, "streak int", "update", GroupStateTimeout.NoTimeout)


# Days to look back without a cursor, statuses that are final or done, seconds that a work folder lives.
LOOK_BACK_DAYS, TERMINAL, DONE, FOLDER_SECONDS = 2, ("unsupported_no_jats", "unsupported_no_text"), ("ok", "ok_full"), 1800


def since_cursor(df: DataFrame, cursor: Column, now: Column, ts: str = "ts", days: int = LOOK_BACK_DAYS) -> DataFrame:
    """What a run has to take: from the day of the cursor on, or of `days` before now where there is none, up to now."""
    first = F.coalesce(F.date_trunc("day", cursor), F.date_trunc("day", now - F.make_interval(days=F.lit(days))))
    return df.where((F.col(ts) >= first) & (F.col(ts) <= now))


def pending(wanted: DataFrame, history: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """wanted without the keys whose last status is done or final; all others, failed and started ones too, are tried again."""
    last = history.groupBy(F.col(key).alias("_k")).agg(F.max_by(status, F.struct(*order)).alias("_s"))
    settled = last.where(F.col("_s").isin(*TERMINAL, *DONE))
    return wanted.join(settled, F.col(key) == F.col("_k"), "left_anti")


def throttled(df: DataFrame, key: str, ts: str, seconds: float, ties: list[str]) -> DataFrame:
    """df with release: when a leaky bucket that passes one row of a key every `seconds` lets it go, as seconds since 1970.

    release(k) = max(arrival(k), release(k - 1) + seconds) = seconds k + max over j <= k of (arrival(j) - seconds j), a running maximum.
    """
    w = Window.partitionBy(key).orderBy(ts, *ties)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = df.withColumn("_k", F.row_number().over(w))
    return rows.withColumn("release", F.max(at - F.col("_k") * seconds).over(w) + F.col("_k") * seconds).drop("_k")


def expired(folders: DataFrame, now: Column, ts: str = "modified", seconds: int = FOLDER_SECONDS) -> DataFrame:
    """Work folders that nothing has touched for longer than `seconds`."""
    return folders.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) > seconds * 1_000_000)


POOL = "key string, tries int, strategy string, state string"


def pool_step(tries: int, ok: bool) -> tuple[int, str, str]:
    """Tries, next strategy and state after one more result."""
    if ok:
        return 0, "none", "done"
    tries += 1
    return tries, ("retry", "retry", "wait", "fallback", "give_up")[min(tries, MOST_TRIES) - 1], "dead" if tries >= MOST_TRIES else "open"


def _pooled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tries, status = state.get if state.exists else (0, "open")
    strategy = "none"
    rows = pd.concat(list(parts)).sort_values("order")
    for ok in rows["ok"]:
        if status != "dead":
            tries, strategy, status = pool_step(tries, bool(ok))
    state.update((tries, status))
    yield pd.DataFrame({"key": [key[0]], "tries": [tries], "strategy": [strategy], "state": [status]})


def failure_pool(results: DataFrame) -> DataFrame:
    """Results (key, ok, order) as a stream -> the state of each key that had news: open, dead after MOST_TRIES failures, or done."""
    return results.groupBy("key").applyInPandasWithState(_pooled, POOL, "tries int, status string", "update", GroupStateTimeout.NoTimeout)


def ingest(source: DataFrame, sink: str, checkpoint: str, **options: Any):
    """Append what is new since the checkpoint to a Parquet table, then stop; a rerun after a failure adds no row twice."""
    return source.writeStream.format("parquet").option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start(sink)


def refresh(source: DataFrame, checkpoint: str, publish):
    """Recompute a payload for every batch of news; publish(batch, id) must overwrite by id, since a batch may come again."""
    return source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
