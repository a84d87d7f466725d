"""Audit rules as data: critical rules flag rows in order, others count; deltas against the run before; paper credibility tiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import formulas

from .tables import top_k

# Highest plausible value by family, for audits and for tiers.
AUDIT_CAPS = {
    "cuprate": 165.0, "iron_based": 110.0, "nickelate": 85.0, "hydride": 270.0, "mgb2": 42.0, "heavy_fermion": 25.0, "fulleride": 45.0,
    "conventional": 28.0, "kagome": 10.0, "organic": 15.0, "bismuthate": 35.0, "bis2_layered": 12.0, "borocarbide": 25.0, "ruthenate": 4.0,
    "chalcogenide": 20.0, "elemental": 12.0,
}
TIER_CAPS = {
    "cuprate": 165.0, "iron_based": 60.0, "hydride": 300.0, "conventional": 40.0, "heavy_fermion": 3.0, "organic": 15.0, "fulleride": 45.0,
    "elemental": 12.0, "mgb2": 42.0, "nickelate": 100.0, "kagome": 5.0, "bismuthate": 35.0, "borocarbide": 25.0, "ruthenate": 2.0,
    "bis2_layered": 15.0, "chalcogenide": 20.0,
}
TIER_TOP, TOLERANCE = 300.0, 1.2


@dataclass(frozen=True)
class Rule:
    """predicate: a condition on the rows; prepare(rows), which rules may share, adds the columns that the condition reads."""

    name: str
    severity: str
    predicate: Column
    prepare: Callable[[DataFrame], DataFrame] | None = None


def capped(table: dict[str, float], family: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), family)


def run(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with needs_review and review_reason after all rules, and `counted`: the warn and info rules that hold.

    A critical rule flags rows that are neither flagged nor decided; a later rule sees the flags of those before it. One pass.
    """
    flagged, reason, counted, prepared = F.col("needs_review"), F.col("review_reason"), [], []
    for rule in rules:
        if rule.prepare and rule.prepare not in prepared:
            rows = rule.prepare(rows)
            prepared.append(rule.prepare)
        holds = F.coalesce(rule.predicate, F.lit(False))
        if rule.severity == "critical":
            hit = holds & ~flagged & F.col("admin_decision").isNull()
            reason, flagged = F.when(hit, F.lit(rule.name)).otherwise(reason), flagged | hit
        else:
            counted.append(F.when(holds & ~flagged, F.lit(rule.name)))
    return rows.withColumns({"_f": flagged, "_r": reason, "counted": F.array_compact(F.array(*counted)) if counted else F.array().cast("array<string>")}).withColumns(
        {"needs_review": F.col("_f"), "review_reason": F.col("_r")}
    ).drop("_f", "_r")


def report(before: DataFrame, after: DataFrame, key: str = "id", samples: int = 10) -> DataFrame:
    """(rule, rows_flagged, sample): what a run has flagged or counted, with the first ids."""
    old = before.select(F.col(key).alias("_k"), F.col("needs_review").alias("_was"))
    new = after.join(old, F.col(key) == F.col("_k")).where("needs_review and not _was").select(F.col("review_reason").alias("rule"), key)
    both = new.unionByName(after.select(F.explode("counted").alias("rule"), key))
    first = top_k(both, ["rule"], [F.col(key)], samples, "_n").groupBy("rule").agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return both.groupBy("rule").agg(F.count("*").alias("rows_flagged")).join(first, "rule")


def deltas(reports: DataFrame) -> DataFrame:
    """Each run's count against the run before it of the same rule."""
    before = F.lag("rows_flagged").over(Window.partitionBy("rule_name").orderBy("started_at"))
    return reports.withColumn("delta", F.col("rows_flagged") - before)


def flat_records(rows: DataFrame) -> DataFrame:
    """(id, place, fields of a record) of summaries that carry their records as an array."""
    return rows.select("id", F.posexplode("records").alias("place", "r")).select("id", "place", "r.*")


def standard(papers: DataFrame, overrides: DataFrame, year: int, records: DataFrame | None = None) -> list[Rule]:
    """The eleven standard rules over summaries. records: (id, place, paper_id, pressure_gpa, tc_kelvin, ambient_sc, year), a row a record;
    without it the summaries carry their records as an array. Rules read one row of flags an entity, summed up before the shuffle."""
    review = papers.where(F.size("materials_extracted") >= 15).select(F.col("id").alias("_paper"))
    caps = overrides.where("field = 'tc_max' and is_cap").groupBy(F.col("canonical").alias("_c")).agg(F.min("override_value").try_cast("double").alias("_cap"))
    gone = papers.where("status = 'retracted'").select(F.col("id").alias("_rp"))

    def of(rows: DataFrame) -> DataFrame:
        return (flat_records(rows) if records is None else records).withColumnRenamed("id", "_m")

    def seen(rows: DataFrame) -> DataFrame:
        p, tc = F.col("pressure_gpa"), F.col("tc_kelvin")
        any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
        flags = of(rows).groupBy("_m").agg(
            any_((p < 0) | (p > 500)).alias("_pressure"), any_((tc > 100) & (p < 50)).alias("_hot"), any_(F.col("ambient_sc") & (p > 1)).alias("_pressed"),
            any_((F.col("year") < 1980) | (F.col("year") > year + 1)).alias("_odd_year"), F.max("year").alias("_latest"),
        )
        return rows.join(flags, F.col("id") == F.col("_m"), "left").drop("_m")

    def reviewed(rows: DataFrame) -> DataFrame:
        first = of(rows).groupBy("_m").agg(F.min_by("paper_id", "place").alias("_first")).join(review, F.col("_first") == F.col("_paper"), "left_semi")
        return rows.join(first.select("_m", F.lit(True).alias("_review")), F.col("id") == F.col("_m"), "left").drop("_m")

    def compound(rows: DataFrame) -> DataFrame:
        return rows.join(caps, F.col("formula_normalized") == F.col("_c"), "left")

    def retracted(rows: DataFrame) -> DataFrame:
        said = of(rows).where("paper_id is not null").groupBy("_m", "paper_id").agg(F.lit(1).alias("_one"))
        all_ = said.join(gone, F.col("paper_id") == F.col("_rp"), "left").groupBy("_m").agg((F.count("*") == F.count("_rp")).alias("_sole"))
        return rows.join(all_, F.col("id") == F.col("_m"), "left").drop("_m")

    return [
        Rule("tc_exceeds_family_cap", "critical", F.col("tc_max") > capped(AUDIT_CAPS, F.col("family"))),
        Rule("tc_at_ambient_above_record", "critical", F.col("ambient_sc") & (F.col("tc_max") > 152)),
        Rule("implausible_pressure", "critical", F.col("_pressure"), seen),
        Rule("hydride_low_pressure_high_tc", "critical", (F.col("family") == "hydride") & F.col("_hot"), seen),
        Rule("ambient_sc_with_high_pressure", "critical", F.col("_pressed"), seen),
        Rule("record_year_out_of_range", "warn", F.col("_odd_year"), seen),
        Rule("arxiv_year_mismatch", "info", F.col("_latest") - 5 > F.col("arxiv_year"), seen),
        Rule("citation_conflation_review_paper", "critical", F.col("id").startswith("mat:") & (F.col("total_papers") == 1) & (F.col("tc_max") > 80) & F.col("_review"), reviewed),
        Rule("tc_exceeds_compound_cap", "critical", F.col("tc_max") > F.col("_cap"), compound),
        Rule("family_unconv_contradiction", "critical", F.col("is_unconventional") & (F.col("family") == "conventional")),
        Rule("sole_source_retracted", "critical", F.col("_sole"), retracted),
    ]


def naming(formula: str = "formula") -> list[Rule]:
    """The four rules on how a formula is written, for a run between releases: text, systems, phases and charges that were taken for formulas."""
    c = F.col(formula)
    like = lambda *reasons: reduce(or_, [c.rlike(p) for r, p in formulas.REFUSED if r in reasons])
    return [
        Rule("ner_extracted_descriptive_text", "critical", like("descriptive_word", "condition_descriptor", "no_uppercase_element")),
        *[Rule(r, "critical", like(r)) for r in ("system_designator_not_compound", "phase_prefix_in_formula", "incomplete_or_charged_formula")],
    ]


def credibility(papers: DataFrame, overrides: DataFrame, refuted: DataFrame) -> DataFrame:
    """(id, tier, reason) of every paper by the first rule that holds; records are read in place, caps and refuted claims joined."""
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    caps = overrides.where("field = 'tc_max' and is_cap").groupBy(plain(F.col("canonical")).alias("_k")).agg(F.min("override_value").try_cast("double").alias("_cap"))
    bad = refuted.select(plain(F.col("canonical")).alias("_rk")).distinct()
    one = papers.select("id", F.explode_outer("materials_extracted").alias("r")).withColumn("k", F.nullif(plain(F.col("r.formula")), F.lit("")))
    one = one.join(caps, F.col("k") == F.col("_k"), "left").join(bad, F.col("k") == F.col("_rk"), "left")
    cap = F.coalesce(F.nullif("_cap", F.lit(0.0)), capped(TIER_CAPS, F.col("r.family")), F.lit(TIER_TOP))
    tc, kind = F.col("r.tc_kelvin"), F.col("r.evidence_type")
    per = one.groupBy(F.col("id").alias("_id")).agg(
        F.count("r").alias("n"),
        F.size(F.collect_set(F.nullif(F.col("r.formula"), F.lit("")))).cast("long").alias("forms"),  # a set, as a distinct count beside mode() shuffles twice more
        (F.count("k") > 0).alias("named"), F.count_if(F.col("k").isNotNull() & F.col("_rk").isNull()).alias("standing"),
        F.count_if(kind.isin("primary", "primary_experimental")).alias("primary"), F.count_if(kind == "cited").alias("cited"),
        F.round(F.avg(F.when(F.col("r").isNotNull(), F.coalesce("r.confidence", F.lit(0.5)))), 9).alias("conf"),
        F.count_if(tc > 0).alias("tcs"), F.count_if((tc > 0) & (tc > cap * TOLERANCE)).alias("odd"),
        F.mode(F.lower(F.nullif(F.trim("r.paper_type"), F.lit(""))), True).alias("voted"),
    )
    p = papers.join(per, F.col("id") == F.col("_id"))
    rate, primary = F.coalesce(F.try_divide("odd", "tcs"), F.lit(0.0)), F.coalesce(F.try_divide("primary", "n"), F.lit(0.0))
    cited, cites = F.coalesce(F.try_divide("cited", "n"), F.lit(0.0)), F.coalesce("citation_count", F.lit(0))
    kind, forms = F.coalesce(F.nullif("paper_type", F.lit("")), F.col("voted"), F.lit("")), F.col("forms")
    pct = lambda c: F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    say = lambda a, *b: F.concat(F.lit(a), *[x.cast("string") for x in b])
    focused = (forms <= 3) & (primary >= 0.8) & (F.col("conf") >= 0.8) & (rate == 0) & (F.col("n") <= 10)
    focus = F.concat(
        F.lit("focused_experimental"), F.when(cites >= 50, say("_citations=", cites)).otherwise(""),
        F.when(F.array_contains(F.coalesce("categories", F.array().cast("array<string>")), "cond-mat.supr-con"), "_supr-con").otherwise(""),
    )
    ladder = [
        (F.col("status") == "retracted", "T5", F.lit("retracted")),
        ((F.col("source") == "aps") | F.col("id").startswith("aps:"), "T1", F.lit("aps_published_article")),
        (F.col("named") & (F.col("standing") == 0), "T5", F.lit("all_formulas_refuted")),
        (F.col("n") == 0, "T3", F.lit("no_extraction_records")),
        (rate > 0.8, "T5", say("anomaly_rate=", pct(rate))),
        (forms > 30, "T4", F.concat(F.lit("review_paper_"), forms, F.lit("_formulas"))),
        (kind == "review", "T4", F.lit("s2_classified_review")),
        (rate > 0.3, "T4", say("high_anomaly_rate=", pct(rate))),
        ((primary == 0) & (F.col("n") > 5), "T4", F.lit("no_primary_evidence_many_records")),
        (F.col("doi").startswith("10.") & (forms <= 10), "T1", F.lit("journal_doi")),
        (focused, "T1", focus),
        ((cites >= 100) & (forms <= 5) & (rate == 0), "T1", say("high_citation_", cites)),
        ((forms <= 10) & (rate == 0), "T2", F.lit("normal")),
        ((forms <= 10) & (rate <= 0.1), "T2", say("minor_anomaly=", pct(rate))),
        ((primary >= 0.5) & (forms <= 15), "T2", F.lit("mostly_primary")),
        (forms > 10, "T3", say("many_formulas_", forms)),
        (cited > 0.5, "T3", say("mostly_cited=", pct(cited))),
        (F.col("conf") < 0.6, "T3", F.concat(F.lit("low_confidence="), F.format_string("%.2f", F.col("conf")))),
    ]
    first = F.coalesce(*[F.when(c, F.struct(F.lit(t).alias("tier"), r.alias("reason"))) for c, t, r in ladder], F.struct(F.lit("T2").alias("tier"), F.lit("default").alias("reason")))
    return p.select("id", first.alias("t")).select("id", "t.tier", "t.reason")


def violations(rows: DataFrame, dims: DataFrame, on: str, value: str, cap: str) -> DataFrame:
    """Rows whose value exceeds the cap of their group: a semi-join on the key with the comparison as residual."""
    d = dims.select(F.col(on).alias("_k"), F.col(cap).alias("_cap"))
    return rows.join(d, (F.col(on) == F.col("_k")) & (F.col(value) > F.col("_cap")), "left_semi")


def conjunction(*conditions: Column | None) -> Column:
    """All given conditions; those that are None do not filter."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))
