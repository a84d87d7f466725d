"""Keyed state that ends: counters, failure pools and runs of failures whose rows go when their time is over.

State lives in Spark's transformWithState with a time to live, so a key that is heard of no more costs nothing after it. Timers tell when a waiting key is due
again. Each job has a batch twin among the functions of `jobs` or here. The sessions need the RocksDB state store (`with_rocksdb`).

A day's counter lives DAY seconds from its first row on; a pool entry KEEP seconds from its last news on, after which the key starts anew; a run of failures
likewise. Times are those of processing (`seconds` may be shortened, as tests do).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import ALERT_AFTER, KEEP_DAYS, pool_step, stamped

# Seconds that a day's counter and a pool's entry live, seconds before a waiting key is due.
DAY, KEEP, WAIT = 86_400, KEEP_DAYS * 86_400, 3_600


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, its state in RocksDB, which has times to live and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Quota(StatefulProcessor):
    """Uses of a key and day; the count of a day is gone `seconds` after its last write."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "day date", "n long", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        news: dict[Any, int] = {}
        for part in rows:  # a part at a time, so that a hot key's batch is never held whole
            for day, n in part.groupby("day").size().items():
                news[day] = news.get(day, 0) + int(n)
        for day, n in sorted(news.items()):
            before = self.used.getValue((day,))
            total = (before[0] if before else 0) + n
            self.used.updateValue((day,), (total,))
            yield pd.DataFrame({"day": [day], "key": [key[0]], "used": [total], "remaining": [max(0, self.limit - total)], "over": [total > self.limit]})


def quota(uses: DataFrame, key: str, limit: int, ts: str = "ts", seconds: int = DAY) -> DataFrame:
    """A stream of uses -> (day, key, used, remaining, over) of the days with news; `jobs.daily_counts` is the batch twin."""
    rows = stamped(uses, ts).select(F.col(key).alias("key"), F.to_date(ts).alias("day"))
    kind = uses.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(_Quota(limit, seconds), f"day date, key {kind}, used long, remaining long, over boolean", "Update", "ProcessingTime")


class _Pool(StatefulProcessor):
    """Tries and state of a key; a key that waits is told to be due by a timer, an entry without news is gone after `seconds`."""

    def __init__(self, seconds: int, wait: float):
        self.seconds, self.wait = seconds, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "tries int, state string", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tries, status = self.entry.get() if self.entry.exists() else (0, "open")
        strategy = "none"
        for part in rows:
            for ok in part.sort_values("order")["ok"]:
                if status != "dead":
                    tries, strategy, status = pool_step(tries, bool(ok))
        self.entry.update((tries, status))
        if strategy == "wait":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.wait * 1000))
        yield pd.DataFrame({"key": [key[0]], "tries": [tries], "strategy": [strategy], "state": [status]})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            tries, status = self.entry.get()
            if status == "open":
                yield pd.DataFrame({"key": [key[0]], "tries": [tries], "strategy": ["due"], "state": [status]})


def pool(results: DataFrame, seconds: int = KEEP, wait: float = WAIT) -> DataFrame:
    """Results (key, ok, order) as a stream -> (key, tries, strategy, state) of the keys with news, and strategy `due` when a waiting key's time has come.

    Rows of one batch count by `order` within each part that Spark hands over. `pooled` is the batch twin.
    """
    kind = results.schema["key"].dataType.simpleString()
    rows = results.select("key", "ok", "order")
    return rows.groupBy("key").transformWithStateInPandas(_Pool(seconds, wait), f"key {kind}, tries int, strategy string, state string", "Update", "ProcessingTime")


def pooled(results: DataFrame, most: int = 5) -> DataFrame:
    """(key, tries, state) after all results of a key in order: dead once `most` failures stand in a row, else done after a success, else open."""
    w = Window.partitionBy("key").orderBy("order")
    run = results.withColumn("_g", F.sum(F.col("ok").cast("int")).over(w))
    streak = F.row_number().over(Window.partitionBy("key", "_g").orderBy("order")) - F.when(F.col("_g") > 0, 1).otherwise(0)
    rows = run.withColumn("_s", streak).groupBy("key").agg(F.max("_s").alias("_most"), F.max_by(F.struct("ok", "_s"), "order").alias("_last"))
    dead = F.col("_most") >= most
    tries = F.when(dead, most).otherwise(F.col("_last._s"))
    return rows.select("key", tries.cast("int").alias("tries"), F.when(dead, "dead").when(F.col("_last.ok"), "done").otherwise("open").alias("state"))


class _Streak(StatefulProcessor):
    def __init__(self, after: int, seconds: int):
        self.after, self.seconds = after, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n int", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.run.get()[0] if self.run.exists() else 0
        raised = False
        for part in rows:
            for failed in part.sort_values("order")["failed"]:
                n = n + 1 if failed else 0
                raised |= n == self.after
        if n:
            self.run.update((n,))
        else:
            self.run.clear()  # a key that works costs nothing
        yield pd.DataFrame({"key": [key[0]], "streak": [n], "alert": [raised]})


def streaks(results: DataFrame, after: int = ALERT_AFTER, seconds: int = KEEP) -> DataFrame:
    """Results (key, failed, order) as a stream -> (key, streak, alert) of the keys with news; `jobs.alerts` is the batch twin."""
    kind = results.schema["key"].dataType.simpleString()
    rows = results.select("key", "failed", "order")
    return rows.groupBy("key").transformWithStateInPandas(_Streak(after, seconds), f"key {kind}, streak int, alert boolean", "Update", "ProcessingTime")
