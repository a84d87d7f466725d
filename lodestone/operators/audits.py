"""Audit runs rule by rule: one that fails is reported as -1 and the others go on; a run that was cut short goes on where it stopped.

A rule sees the flags of those before it. What it flags is written first, then its report, each with one atomic commit of a versioned table (flags: run, id,
rule; reports: run, rule, number of rows, difference to the last report of the rule that did not fail, first ids). A rule whose report is there is not run
again; one whose flags are there, but not its report, finds its own flags as if they weren't, and writes them once.

Defined cases: a rule that holds nowhere reports 0; without an earlier report the difference is null, as it is for a rule that fails; rows
with a null id can't be flagged or counted; a null condition doesn't hold; repeated ids are one row of the flags, and count as often as they are there.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import discard, materialised
from lodestone.streaming.versions import VersionedTable

from .rules import Rule

log = logging.getLogger(__name__)
REPORTS = "run string, rule_name string, place int, severity string, rows_flagged long, delta_vs_previous long, sample_ids array<string>, error string"
FLAGS = "run string, id string, rule_name string, place int"
FAILED = -1


def tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    """Reports and flags of all runs, under one folder. A flag stays with the rule that set it first."""
    return VersionedTable(spark, f"{path}/reports", REPORTS, ["run", "rule_name"]), VersionedTable(spark, f"{path}/flags", FLAGS, ["run", "id"], update=[])


def flagged(rows: DataFrame, flags: VersionedTable, run: str, key: str = "id", other_than: str | None = None) -> DataFrame:
    """rows with needs_review and review_reason after the flags of a run."""
    own = flags.read().where(F.col("run") == run)
    own = own.where(F.col("rule_name") != other_than) if other_than else own
    joined = rows.join(own.select(F.col("id").alias("_id"), F.col("rule_name").alias("_rule")), F.col(key).cast("string") == F.col("_id"), "left")
    hit = F.col("_rule").isNotNull()
    return joined.withColumns({"needs_review": F.coalesce("needs_review", F.lit(False)) | hit, "review_reason": F.when(hit, F.col("_rule")).otherwise(F.col("review_reason"))}).drop("_id", "_rule")


def audit(rows: DataFrame, rules: list[Rule], path: str, run: str, key: str = "id", samples: int = 10) -> DataFrame:
    """Run every rule that has no report in this run yet; rows with the flags of all. Runs are told apart, and put in order, by their names."""
    spark = rows.sparkSession
    reports, flags = tables(spark, path)
    done = {r.rule_name for r in reports.read().where(F.col("run") == run).select("rule_name").collect()}  # as many rows as there are rules
    for place, rule in enumerate(rules):
        if rule.name in done:
            continue
        outcome = _one(rows, rule, flags, run, place, key, samples)
        last = reports.read().where((F.col("rule_name") == rule.name) & (F.col("run") < run) & (F.col("rows_flagged") >= 0)).agg(F.max_by("rows_flagged", "run")).first()[0]
        n, ids, error = outcome
        delta = n - last if last is not None and n != FAILED else None
        one = spark.createDataFrame([(run, rule.name, place, rule.severity, n, delta, ids, error)], REPORTS)
        reports.upsert(one, place, run)
    return flagged(rows, flags, run, key)


def _one(rows: DataFrame, rule: Rule, flags: VersionedTable, run: str, place: int, key: str, samples: int) -> tuple[int, list[str], str | None]:
    """Rows, first ids and error of one rule; what a critical one finds is written."""
    hits = None
    try:
        seen = flagged(rows, flags, run, key, other_than=rule.name)
        seen = rule.prepare(seen) if rule.prepare else seen
        open_ = ~F.col("needs_review") & F.coalesce(rule.predicate, F.lit(False)) & F.col(key).isNotNull()
        critical = rule.severity == "critical"
        hits = seen.where(open_ & F.col("admin_decision").isNull() if critical else open_).select(F.col(key).cast("string").alias("id"))
        hits = materialised(hits, "hits")
        n, ids = hits.count(), [r.id for r in hits.distinct().orderBy("id").limit(samples).collect()]
        if critical:
            flags.upsert(hits.distinct().select(F.lit(run).alias("run"), "id", F.lit(rule.name).alias("rule_name"), F.lit(place).alias("place")), place, run)
        return n, ids, None
    except Exception as e:  # noqa: BLE001  whatever a rule raises is its own failure
        log.warning("audit rule %s failed: %s", rule.name, str(e).splitlines()[0][:300] if str(e) else type(e).__name__)
        return FAILED, [], str(e).splitlines()[0][:300] if str(e) else type(e).__name__
    finally:
        if hits is not None and hasattr(hits, "_lodestone_path"):
            discard(hits)
