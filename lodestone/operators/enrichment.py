"""Runs that ask something outside about many rows, and go on where they stopped: extraction of hydride parameters, look-ups of formulas.

Extraction. What is asked is a function of one paper that the caller brings (a model, a service, a parser); a paper on which it fails is an event with an
error, and the others go on. A run is cut into rounds by a hash of the id. Each round is written before anything counts; then its records are merged
by record key, then its events are committed. A job that dies in between asks the round again and merges the same keys: nothing is there twice.

Defined cases: a null id is no paper; repeated ids are asked once a row and make one event; a paper without usable records is an event with 0 records;
records out of range or without a formula are left out; of equal record keys the most confident counts; empty tables give no events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import formulas, text
from lodestone.session import discard, materialised
from lodestone.streaming.versions import VersionedTable

from . import harvest

# What speaks of hydrides in a title or an abstract.
HYDRIDE_WORDS = (
    r"hydride|superhydride|hydrogen-rich|hydrogen rich|clathrate hydride|sulfur hydride|lanthanum hydride|yttrium hydride|"
    r"\bH[0-9]{1,3}[A-Z][a-z]?\b|\bD[0-9]{1,3}[A-Z][a-z]?\b|\b[A-Z][a-z]?H[0-9]{1,3}\b"
)
FIELDS = (
    "formula", "tc_kelvin", "pressure_gpa", "lambda_eph", "mu_star", "omega_log_k", "omega_log_source_value", "omega_log_source_unit", "method",
    "evidence_type", "confidence",
)
EVENTS = "paper_id string, round string, ok boolean, error string, n_records long, n_flagged long"
PARAMETERS = (
    "record_key string, material_id string, paper_id string, source string, doi string, year int, formula string, formula_normalized string, tc_kelvin double, "
    "pressure_gpa double, lambda_eph double, mu_star double, omega_log_k double, method string, evidence_type string, confidence double, validation_flags array<string>"
)
_OUT = f"paper_id string, ok boolean, error string, records array<struct<{', '.join(f'{c}:string' for c in FIELDS)}>>"


def tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    """Parameters by record key and the last event of each paper, under one folder."""
    return VersionedTable(spark, f"{path}/parameters", PARAMETERS, ["record_key"]), VersionedTable(spark, f"{path}/events", EVENTS, ["paper_id"])


def candidates(papers: DataFrame, source: str = "all", wanted: DataFrame | None = None) -> DataFrame:
    """Papers (id, source, doi, title, abstract, said) to ask: those that `wanted` (id, doi) names, else those whose words or records speak of hydrides."""
    rows = papers.where("id is not null")
    if wanted is not None:
        by_id = wanted.where("id is not null").select(F.col("id").alias("_w"))
        by_doi = wanted.select(text.doi(F.col("doi")).alias("_w")).where("_w is not null")
        named = rows.join(by_id, F.col("id") == F.col("_w"), "left_semi").select("id").unionByName(rows.join(by_doi, text.doi(F.col("doi")) == F.col("_w"), "left_semi").select("id"))
        rows = rows.join(named, "id", "left_semi")
    else:
        words = F.concat_ws("\n", "title", "abstract")
        rows = rows.where(words.rlike(f"(?i){HYDRIDE_WORDS}") | F.coalesce(F.lower("said").contains("hydride"), F.lit(False)))
    return rows if source == "all" else rows.where(F.col("source") == source)


def pending(papers: DataFrame, events: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Papers without an event; with retry_failed those whose last one failed too."""
    seen = events.where("ok") if retry_failed else events
    return papers.join(seen.select(F.col("paper_id").alias("id")), "id", "left_anti")


def asked(papers: DataFrame, extract: Callable[[dict], list[dict]]) -> DataFrame:
    """(paper_id, ok, error, records): extract called once a row, its fields read as text. What it raises is the row's error."""

    def one(row: dict) -> tuple:
        try:
            found = [{c: None if r.get(c) is None else str(r[c]) for c in FIELDS} for r in extract(row)]
            return row["id"], True, None, found
        except Exception as e:  # noqa: BLE001  whatever it raises belongs to this paper alone
            return row["id"], False, f"{type(e).__name__}: {e}"[:300], []

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=["paper_id", "ok", "error", "records"])

    return papers.mapInPandas(batches, _OUT)


def parameters(answers: DataFrame, papers: DataFrame, materials: DataFrame) -> DataFrame:
    """Answers as parameter rows: cleaned, in range, one a record key, with the summary of that formula and what the paper says of itself."""
    raw = answers.where("ok").select("paper_id", F.explode("records").alias("r")).select("paper_id", "r.*")
    rows = harvest.hydrides(raw).withColumnsRenamed({"key": "formula_normalized", "flags": "validation_flags"})
    own = materials.groupBy(F.col("formula_normalized").alias("_k")).agg(F.min("id").alias("material_id"))
    facts = papers.groupBy(F.col("id").alias("_p")).agg(F.min("source").alias("source"), F.min("doi").alias("doi"), F.min(F.year(F.coalesce("date_published", "date_submitted"))).alias("year"))
    rows = rows.join(own, F.col("formula_normalized") == F.col("_k"), "left").join(facts, F.col("paper_id") == F.col("_p"), "left")
    return rows.select(*[c.split()[0] for c in PARAMETERS.split(", ")])


def run(papers: DataFrame, materials: DataFrame, extract: Callable[[dict], list[dict]], path: str, name: str, rounds: int = 8, retry_failed: bool = False,
        before_events: Callable[[int], None] | None = None) -> None:
    """Ask every pending paper, in `rounds` parts that are committed one by one. name tells runs apart; the same name goes on with its run.

    before_events is called between the two commits of a round, for tests.
    """
    found, events = tables(papers.sparkSession, path)
    for k in range(rounds):
        tag = f"{name}/{rounds}"
        part = pending(papers, events.read(), retry_failed).where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        answers = materialised(asked(part, extract), "answers")
        rows = materialised(parameters(answers, part, materials), "parameters")
        try:
            found.upsert(rows, max(found.versions(), default=0) + 1, tag)  # by key, so a round that comes again changes nothing
            if before_events:
                before_events(k)
            per = rows.groupBy(F.col("paper_id").alias("_p")).agg(F.count("*").alias("n"), F.count_if(F.size("validation_flags") > 0).alias("f"))
            one = answers.groupBy("paper_id").agg(F.min("ok").alias("ok"), F.min("error").alias("error")).join(per, F.col("paper_id") == F.col("_p"), "left")
            told = one.select("paper_id", F.lit(f"{tag}/{k}").alias("round"), "ok", "error", F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("f", F.lit(0)).alias("n_flagged"))
            events.upsert(told, max(events.versions(), default=0) + 1, tag)
        finally:
            discard(answers)
            discard(rows)


def looked_up(materials: DataFrame, hits: DataFrame, now: Column, days: int = 30, force: bool = False) -> DataFrame:
    """materials (id, formula, mp_id, mp_alternate_ids, mp_synced_at) after a round of look-ups: rows that are due have their match, alternates and the time.

    hits: (formula, material_id, energy_above_hull), what the service said of each formula, underscores left out. A formula that can't be looked up, one
    that failed and one without hits are stamped without a match, so they are not asked again before their time; rows that aren't due are as they were.
    """
    best = harvest.best_match(hits, "formula").select(F.col("formula").alias("_f"), F.col("primary").alias("_primary"), F.col("alternates").alias("_alternates"))
    due = F.coalesce(harvest.stale(F.col("mp_synced_at"), days, now, force), F.lit(True))
    asks = F.when(due & harvest.unsearchable(F.col("formula")).isNull(), F.replace("formula", F.lit("_"), F.lit("")))
    j = materials.withColumns({"_due": due, "_asks": asks}).join(best, F.col("_asks") == F.col("_f"), "left")
    none = F.array().cast("array<string>")
    new = {
        "mp_id": F.when(F.col("_due"), F.col("_primary")).otherwise(F.col("mp_id")), "mp_synced_at": F.when(F.col("_due"), now).otherwise(F.col("mp_synced_at")),
        "mp_alternate_ids": F.when(F.col("_due"), F.coalesce("_alternates", none)).otherwise(F.col("mp_alternate_ids")),
    }
    return j.withColumns(new).select(*materials.columns)


def to_look_up(materials: DataFrame, now: Column, days: int = 30, force: bool = False) -> DataFrame:
    """(formula): the distinct formulas that a round of look-ups asks for, as they are asked; each one once, however many rows have it."""
    due = materials.where(harvest.stale(F.col("mp_synced_at"), days, now, force) & harvest.unsearchable(F.col("formula")).isNull())
    return due.select(F.replace("formula", F.lit("_"), F.lit("")).alias("formula")).distinct()


def normalised(materials: DataFrame) -> DataFrame:
    """materials with formula_normalized, the key that records are linked by, once a distinct spelling."""
    return formulas.described(materials, "formula", formula_normalized=formulas.canonical)
