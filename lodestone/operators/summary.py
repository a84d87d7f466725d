"""From nested evidence records to one summary row an entity, with overrides, refuted claims, variants and reconciliation.

`records()` explodes papers once and says for every record why it is skipped; `summarise()` is a set of grouped aggregates over
the accepted records, each combined before its shuffle on the entity key, joined at the end; nothing collects an entity's records.
Order-dependent picks use the total order (paper_id, ord), so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import formulas
from lodestone.functions.numbers import short_number as plain_number
from lodestone.functions.text import source_label
from lodestone.session import discard, materialised

from . import evidence as ev
from .tables import stack_metrics

# Fixed values of the pipeline.
SANITY_MAX, CAP_SLACK, MIN_CONFIDENCE, TC_RANGE, NO_FAMILY_MAX = 250.0, 1.5, 0.3, (0.01, 300.0), 45.0
TIER_FACTOR = {"T1": 1.0, "T2": 1.0, "T3": 0.8, "T4": 0.0, "T5": 0.0}
FAMILY_CEILING = {
    "cuprate": 180.0, "iron_based": 110.0, "nickelate": 110.0, "mgb2": 50.0, "fulleride": 50.0, "bismuthate": 45.0, "conventional": 45.0,
    "chalcogenide": 40.0, "elemental": 40.0, "borocarbide": 30.0, "bis2_layered": 30.0, "heavy_fermion": 30.0, "organic": 25.0,
    "kagome": 15.0, "ruthenate": 10.0,
}
MEASURED = (
    "resistivity", "susceptibility", "specific_heat", "arpes", "musr", "stm", "neutron", "nmr", "nqr", "magnetization", "thermal_conductivity",
    "raman scattering", "raman", "andreev reflection", "nernst", "tunneling", "esr", "torque magnetometry", "hall effect", "hall_effect", "transport",
)
CALCULATED = (
    "calculation", "dft", "first-principles", "first principles", "computational", "ab initio", "ab-initio", "allen-dynes", "eliashberg", "tight-binding",
)
INSULATORS = ["batio3", "pbtio3", "catio3", "laalo3", "mgo", "al2o3", "sio2", "srzro3", "bazro3", "latio3", "tio2"]
GARBAGE = (
    "descriptive_word", "condition_descriptor", "invalid_start", "system_designator_not_compound", "phase_prefix_in_formula",
    "incomplete_or_charged_formula", "english_element_name", "literal_placeholder", "single_element_symbol", "concatenated_prose",
    "trade_name_not_compound", "generic_family_name", "forbidden_char", "ner_extracted_descriptive_text",
)
MOST_CHARS = {
    "crystal_structure": 100, "space_group": 50, "structure_phase": 50, "gap_structure": 50, "pairing_symmetry": 100, "hc2_conditions": 200,
    "tc_max_conditions": 300, "competing_order": 100, "pressure_type": 50, "sample_form": 50, "substrate": 100, "doping_type": 50,
    "review_reason": 200, "family": 50,
}
VOTED = ["structure_phase", "family", "pairing_symmetry", "gap_structure", "competing_order", "sample_form", "pressure_type", "doping_type"]
FLAGS = ["ambient_sc", "is_unconventional", "disputed"]
LARGEST = ["hc2_tesla", "lambda_eph", "omega_log_k", "rho_s_mev", "t_cdw_k", "t_sdw_k", "t_afm_k"]
MEDIANS = ["rho_exponent", "doping_level"]
TEXT_OVERRIDES = ["pairing_symmetry", "gap_structure", "competing_order", "crystal_structure", "space_group", "structure_phase"]
ROUNDED = ["tc_max", "tc_ambient", "tc_max_experimental", "tc_max_theoretical", *LARGEST, *MEDIANS]
ORDER = ["paper_id", "ord"]


def is_theory(evidence: Column, measurement: Column, paper_type: Column) -> Column:
    """Calculated rather than measured: an explicit evidence type, else a named technique, else the paper's type."""
    m = F.lower(F.trim(F.coalesce(measurement, F.lit(""))))
    return (
        F.when(evidence == "primary_theoretical", True)
        .when(evidence == "primary_experimental", False)
        .when(m.isin(*MEASURED), False)
        .when(m.isin(*CALCULATED), True)
        .otherwise(F.coalesce(F.lower(F.trim(paper_type)).isin("theoretical", "computational"), F.lit(False)))
    )


def classification(evidence: Column, measurement: Column, paper_type: Column) -> Column:
    """cited, theoretical or experimental, as audits name a record."""
    return F.when(evidence == "cited", "cited").when(is_theory(evidence, measurement, paper_type), "theoretical").otherwise("experimental")


def counting(papers: DataFrame) -> DataFrame:
    """The papers that count, with `tier` and the `factor` of its confidence: neither retracted nor of a tier without weight."""
    tier = F.when((F.col("source") == "aps") | F.col("id").startswith("aps:"), "T1").otherwise(F.col("credibility_tier"))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TIER_FACTOR.items() for x in p]), tier), F.lit(1.0))
    return papers.where("status is null or status <> 'retracted'").withColumns({"tier": tier, "factor": factor}).where("factor > 0")


def records(papers: DataFrame) -> DataFrame:
    """One row a record of papers that count, with `key`, the confidence after the paper's tier, and `skip`: why it is left out."""
    live = counting(papers)
    date = F.coalesce("date_submitted", "date_published")
    flat = live.select(F.col("id").alias("paper_id"), "tier", "factor", F.year(date).alias("paper_year"), F.posexplode("materials_extracted").alias("ord", "r"))
    given = set(flat.select("r.*").columns)
    flat = flat.select("paper_id", "tier", "factor", "paper_year", "ord", *[F.col(f"r.{c}") for c in given if c not in ("paper_id", "ord", "year")],
                       F.coalesce(F.col("r.year") if "year" in given else F.lit(None), F.col("paper_year")).cast("int").alias("year"))
    on_bare = lambda f: lambda c: f(F.regexp_replace(F.trim(c), r"(?U)\s+", ""))
    flat = formulas.described(flat, "formula", True, key=on_bare(formulas.canonical), _reason=on_bare(formulas.invalid_reason), shown=on_bare(formulas.display))
    skip = F.coalesce(
        F.when(F.coalesce("formula", F.lit("")) == "", "no_formula"),
        F.col("_reason"),
        F.when(F.col("evidence_type") == "cited", "cited"),
        F.when(F.col("confidence") < MIN_CONFIDENCE, "low_confidence"),
        F.when(~F.col("tc_kelvin").between(*TC_RANGE), "tc_out_of_range"),
        F.when(F.col("key") == "", "empty_key"),
    )
    lowered = F.when(F.col("factor") < 1, F.round(F.coalesce("confidence", F.lit(ev.DEFAULT_WEIGHT)) * F.col("factor"), 3)).otherwise(F.col("confidence"))
    return flat.withColumns({"skip": skip, "confidence": lowered}).drop("factor", "paper_year", "_reason")


def _first_override(overrides: DataFrame, cap: bool) -> DataFrame:
    """(canonical, field, value, source): the first exact or cap entry of each field, by source then value."""
    rows = overrides.where(F.col("is_cap") == cap)
    return rows.groupBy("canonical", "field").agg(F.min(F.struct("source", "override_value")).alias("o")).select(
        "canonical", "field", F.col("o.override_value").alias("value"), F.col("o.source").alias("source")
    )


def phase_checked(phase: Column, shown: Column) -> Column:
    """Null where the phase contradicts the elements of the formula."""
    els = F.regexp_extract_all(shown, F.lit("[A-Z][a-z]?"), F.lit(0))
    has = lambda *n: F.arrays_overlap(els, F.array(*map(F.lit, n)))
    p = F.regexp_replace(F.lower(phase), "^cuprate_", "")
    wrong = (phase.startswith("cuprate") & ~has("Cu")) | ((p == "123") & has("Cu") & has("Ce") & ~has("Ba")) | ((p == "214") & has("Hg", "Tl"))
    return F.when(~wrong, phase)


def _by_field(rows: DataFrame, fields: Column, *keep: str) -> DataFrame:
    """A row a record and field: e (key, field), v if the fields come with values, and the columns to keep. All fields then share one pass."""
    long = rows.select("key", *keep, F.explode(fields).alias("f"))
    if dict(long.dtypes)["f"] == "string":
        return long.select(F.struct("key", F.col("f").alias("field")).alias("e"), *keep)
    return long.select(F.struct("key", "f.field").alias("e"), "f.v", *keep)


def _wide(long: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a key: each column is one field's value."""
    return long.groupBy(F.col("e.key").alias("key")).agg(*[F.max(F.when(F.col("e.field") == f, F.col(v))).alias(c) for c, (f, v) in columns.items()])


def summarise(rows: DataFrame, overrides: DataFrame | None = None, refuted: DataFrame | None = None) -> DataFrame:
    """One row a key from accepted records (see `records`): columns of the summary, needs_review and review_reason."""
    spark, curated = rows.sparkSession, overrides is not None
    if overrides is None:
        overrides = spark.createDataFrame([], "canonical string, field string, override_value string, is_cap boolean, source string")
    if refuted is None:
        refuted = spark.createDataFrame([], "canonical string, claim_type string, claimed_tc double")
    if curated:
        cap = overrides.where("is_cap and field = 'tc_max'").groupBy(F.col("canonical").alias("_k")).agg(F.min("override_value").try_cast("double").alias("cap"))
        rows = rows.join(materialised(cap, "caps"), F.col("key") == F.col("_k"), "left").drop("_k")  # written, so that its size is known
    else:
        rows = rows.withColumn("cap", F.lit(None).cast("double"))
    tc = F.col("tc_kelvin")
    rows = rows.where("key is not null").withColumn("bad", F.coalesce((tc > SANITY_MAX) | (tc > F.col("cap") * CAP_SLACK), F.lit(False)))
    rows = rows.withColumn("theory", is_theory(F.col("evidence_type"), F.col("measurement"), F.col("paper_type")))
    rows = rows.withColumn("cited", F.coalesce(F.col("evidence_type") == "cited", F.lit(False)))
    regime = F.coalesce("tc_regime", F.lit("bulk_equilibrium"))
    rows = rows.withColumn("ambient", F.coalesce(tc.isNotNull() & F.col("ambient_sc") & ~regime.isin("high_pressure", "interface") & ~F.col("theory"), F.lit(False)))
    written = rows = materialised(rows, "records")  # read by every aggregate below
    counts = materialised(rows.groupBy("key").agg(F.count("*").alias("given"), F.count_if(~F.col("bad")).alias("good")), "counts")
    mixed = counts.where("good between 1 and given - 1").select(F.col("key").alias("_k"))
    if not mixed.isEmpty():  # only entities with records of both kinds lose some: where there are none, nothing is written again
        rows = materialised(rows.join(mixed, (F.col("key") == F.col("_k")) & F.col("bad"), "left_anti"), "kept")
        discard(written)
    kinds = F.array_compact(F.array(F.when(~F.col("theory") & ~F.col("cited"), "exp"), F.when(F.col("theory"), "theo"), F.when(F.col("ambient"), "amb")))
    maxima = ev.corroborated_max(_by_field(rows, kinds, "paper_id", "tc_kelvin"), "e", "paper_id", "tc_kelvin", "tc", "sup")
    there = lambda fields: F.filter(F.array(*fields), lambda f: f["v"].isNotNull())  # noqa: E731  what a record leaves out makes no row
    said = there([F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in VOTED])
    fields = F.explode(F.array(*[F.struct("key", F.lit(c).alias("field")) for c in VOTED]))
    standing = counts.select(fields.alias("e"), F.when(F.col("good") == 0, F.col("given")).otherwise(F.col("good")).alias("records"))
    votes = ev.weighted_mode(_by_field(rows, said, "paper_id", "confidence"), "e", "paper_id", "v", "confidence", "v", standing)
    middles = there([F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in MEDIANS])
    medians = ev.exact_median(_by_field(rows, middles), "e", "v", "v")
    tops = [
        _wide(maxima, {f"{v}_{k}": (k, v) for k in ("exp", "theo", "amb") for v in ("tc", "sup")}),
        _wide(votes, {c: (c, "v") for c in VOTED}),
        ev.display_form(rows, "key", "shown", "formula"),
        _wide(medians, {c: (c, "v") for c in MEDIANS}),
    ]
    amb = F.when(F.col("ambient"), tc)
    sizes = rows.groupBy("key", "paper_id").agg(F.lit(1).alias("_one")).groupBy("key").agg(F.count("paper_id").alias("total_papers"))
    base = rows.groupBy("key").agg(  # numbers only: one hash aggregation, combined to a row an entity and partition
        F.max("cap").alias("cap"),
        F.min(F.when(F.col("year") > 1900, F.col("year"))).alias("arxiv_year"),
        F.max(F.coalesce("ambient_sc", F.lit(False))).alias("any_ambient"),
        ev.spread_dispute(amb).alias("spread"),
        ev.dominance(F.col("cited"), F.col("theory")).alias("dominant_evidence"),
        *[F.max(c).alias(c) for c in LARGEST], *[ev.agreed_flag(F.col(c), F.col("confidence")).alias(c) for c in FLAGS],
    )
    picks = rows.groupBy("key").agg(
        ev.earliest_filled("crystal_structure", "year", ORDER).alias("crystal_structure"),
        ev.earliest_filled("space_group", "year", ORDER).alias("space_group"),
        ev.first_filled("hc2_conditions", ORDER).alias("hc2_conditions"),
        ev.first_filled("substrate", ORDER).alias("substrate"),
        F.min_by(F.struct(F.col("lattice_a").alias("a"), F.col("lattice_c").alias("c")),
                 F.when(F.col("lattice_a").isNotNull() | F.col("lattice_c").isNotNull(), F.struct(*ORDER))).alias("lattice_params"),
        F.min("tier").alias("best_credibility_tier"),
    )
    s = base
    for part in (counts, sizes, picks, *tops):
        s = s.join(part.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"), "left").drop("_k")
    votes = s = materialised(s, "votes")
    theory_only = F.col("tc_exp").isNull()
    s = s.withColumn("tc_max", F.coalesce("tc_exp", "tc_theo")).withColumn("sup", F.coalesce(F.when(theory_only, F.col("sup_theo")).otherwise(F.col("sup_exp")), F.lit(0)))
    raised = F.coalesce(F.col("tc_amb") > F.col("tc_max"), F.lit(False))
    s = s.withColumns({"sup": F.when(raised, F.greatest("sup", F.lit(1))).otherwise(F.col("sup")), "tc_max": F.when(raised, F.col("tc_amb")).otherwise(F.col("tc_max")), "basis_theory": theory_only})
    s = s.join(_conditions(rows, s), F.col("key") == F.col("_ck"), "left").drop("_ck")
    noted = F.concat(F.lit("confirmed by "), F.col("sup"), F.lit(" papers"))
    s = s.withColumn("tc_max_conditions", F.when(F.col("tc_max").isNotNull(), F.nullif(F.concat_ws(", ", "argmax", F.when(F.col("sup") >= 2, noted)), F.lit(""))))
    rule = formulas.family(F.col("formula"))
    layered = (rule == "bis2_layered") & F.coalesce(F.col("family").isin("chalcogenide", "bismuthate"), F.lit(True))
    s = s.withColumn("family", F.when(layered, "bis2_layered").otherwise(F.coalesce("family", rule)))
    s = s.withColumns({
        "structure_phase": phase_checked(F.col("structure_phase"), F.col("formula")),
        "ambient_sc": F.when(F.col("any_ambient"), True).otherwise(F.col("ambient_sc")),
        "is_unconventional": F.coalesce("is_unconventional", formulas.unconventional(F.col("family"))),
        "disputed": F.col("spread") | F.coalesce("disputed", F.lit(False)),
        "has_competing_order": F.col("competing_order").isNotNull() | F.col("t_cdw_k").isNotNull() | F.col("t_sdw_k").isNotNull() | F.col("t_afm_k").isNotNull(),
        "face": formulas.interface(formulas.canonical(F.col("formula"))),
    })
    derived = s = materialised(s, "derived")
    for done in (rows, counts, votes):
        discard(done)
    s = s.withColumn("review_reason", review_reason()).withColumn("needs_review", F.col("review_reason").isNotNull())
    s = s.withColumnsRenamed({"tc_exp": "tc_max_experimental", "tc_theo": "tc_max_theoretical", "tc_amb": "tc_ambient"})
    if curated:
        s = materialised(apply_overrides(s, overrides), "curated")
        discard(derived)
    claim = refuted.groupBy(F.col("canonical").alias("_k")).agg(F.min("claim_type").alias("claim"))
    s = s.join(claim, F.col("key") == F.col("_k"), "left").drop("_k")
    noted = F.concat(F.lit("refuted:"), F.col("claim"))
    s = s.withColumns({"disputed": F.col("disputed") | F.col("claim").isNotNull(), "review_reason": F.nullif(F.concat_ws("; ", "review_reason", noted), F.lit(""))})
    s = s.withColumn("tc_ambient", F.when(F.col("tc_ambient") > F.col("tc_max"), F.col("tc_max")).otherwise(F.col("tc_ambient")))
    s = s.withColumns({c: F.bround(c, 3) for c in ROUNDED})
    s = s.withColumn("pairing_symmetry", F.when((F.col("family") == "cuprate") & F.col("pairing_symmetry").isNull(), "d-wave").otherwise(F.col("pairing_symmetry")))
    s = s.withColumns({c: F.when(F.char_length(c) <= n, F.col(c)) for c, n in MOST_CHARS.items()})
    return s.select(
        formulas.entity_id(F.col("key")).alias("id"), F.substring("formula", 1, 200).alias("formula"), F.col("key").alias("formula_normalized"), "family", "tc_max",
        "tc_max_conditions", "tc_ambient", "dominant_evidence", "tc_max_experimental", "tc_max_theoretical", "ambient_sc", "arxiv_year", "total_papers",
        "crystal_structure", "space_group", "structure_phase", "lattice_params", "pairing_symmetry", "gap_structure", "hc2_conditions", *LARGEST, *MEDIANS,
        "competing_order", "has_competing_order", "sample_form", "substrate", "pressure_type", "doping_type", "is_unconventional", "disputed",
        F.col("face.substrate").alias("formula_substrate"), F.col("face.overlayer").alias("formula_overlayer"), "best_credibility_tier", "needs_review", "review_reason",
    )


def _conditions(rows: DataFrame, s: DataFrame) -> DataFrame:
    """(_ck, argmax): what the first record at the headline value says of itself."""
    head = s.select(F.col("key").alias("_ck"), F.col("tc_max").alias("_top"), F.col("basis_theory").alias("_theo"))
    at = rows.join(head, (F.col("key") == F.col("_ck")) & (F.col("tc_kelvin") == F.col("_top")))
    at = at.where((F.col("_theo") & F.col("theory")) | (~F.col("_theo") & ~F.col("theory") & ~F.col("cited")))
    p = F.col("pressure_gpa")
    parts = F.concat_ws(
        ", ",
        F.when(F.col("_theo"), "theoretical (DFT/computational)"),
        F.when(p > 0, F.concat(F.lit("P="), plain_number(p), F.lit(" GPa"))).when(p.isNotNull(), "ambient"),
        ev.filled("sample_form"),
        F.when(F.lower("measurement") != "unknown", ev.filled("measurement")),
        source_label(F.col("paper_id")),
    )
    return at.groupBy("_ck").agg(F.min_by(F.nullif(parts, F.lit("")), F.struct(*ORDER)).alias("argmax"))


def review_reason() -> Column:
    """The first gate that holds the row back for review, null if none does."""
    tc, cap, fam, shown = F.col("tc_max"), F.col("cap"), F.col("family"), F.col("formula")
    one = lambda c: F.format_string("%.1f", c)
    ceiling = F.try_element_at(F.create_map(*[F.lit(x) for p in FAMILY_CEILING.items() for x in p]), fam)
    els = F.regexp_extract_all(shown, F.lit("[A-Z][a-z]?"), F.lit(0))
    some = lambda names: F.arrays_overlap(els, F.array(*map(F.lit, names.split())))
    manganite = some("Mn") & some("O") & some("La Pr Nd Sm Y Ca Sr Ba Bi") & ~some("Cu Fe S Se Te")
    return F.coalesce(
        F.when(F.col("good") == 0, F.concat(F.lit("all_"), F.col("given"), F.lit("_records_failed_sanity_checks"))),
        F.when(tc > SANITY_MAX, F.lit("tc_max_exceeds_250K")),
        F.when(F.col("tc_amb") > SANITY_MAX, F.lit("tc_ambient_exceeds_250K")),
        F.when((F.col("total_papers") == 1) & (tc > cap * CAP_SLACK), F.concat(F.lit("single_paper_exceeds_cap: tc_max="), one(tc), F.lit(" > cap="), one(cap), F.lit("*1.5"))),
        F.when(cap.isNull() & (tc > ceiling), F.concat(F.lit("tc_max_"), one(tc), F.lit("_implausible_for_"), fam, F.lit("_ceiling_"), F.format_string("%.0f", ceiling), F.lit("K"))),
        F.when(
            cap.isNull() & fam.isNull() & (tc > NO_FAMILY_MAX) & ~shown.rlike(r"H(?:[2-9][0-9]*(?:\.[0-9]+)?|1[0-9]+)"),
            F.concat(F.lit("tc_max_"), one(tc), F.lit("_implausible_for_null_family_ceiling_45K")),
        ),
        F.when(manganite, F.lit("non_sc_material_suspected: CMR/AFM manganite")),
        F.when(formulas.signature(shown).isin(INSULATORS), F.lit("non_sc_material_suspected: ferroelectric/insulator")),
    )


def apply_overrides(s: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated values on the summary: an exact one replaces the field, a cap only lowers it; what was done is noted in review_reason."""
    fields = [c for c in s.columns if c in TEXT_OVERRIDES or dict(s.dtypes)[c] == "double"]
    exact, caps = _first_override(overrides, False), _first_override(overrides, True)
    both = exact.withColumn("cap", F.lit(False)).unionByName(caps.withColumn("cap", F.lit(True)))
    one = both.groupBy("canonical", "field").agg(F.min(F.struct("cap", "value", "source")).alias("o"))
    per = one.groupBy(F.col("canonical").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("field", "o"))).alias("_o"))
    s = s.join(per, F.col("key") == F.col("_k"), "left").drop("_k")
    notes, new = [], {}
    for c in fields:
        o = F.try_element_at("_o", F.lit(c))
        if c in TEXT_OVERRIDES:
            hit, value = ~o["cap"], o["value"]
            note = F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit("None")), F.lit(" -> "), value, F.lit(" (override: "), o["source"], F.lit(")"))
        else:
            value = o["value"].try_cast("double")
            hit = F.when(o["cap"], F.col(c) > value).otherwise(value.isNotNull())
            said = F.when(o["cap"], F.concat(F.lit(" clamped to "), plain_number(value), F.lit(" (per-compound cap: "))).otherwise(
                F.concat(F.lit(" -> "), plain_number(value), F.lit(" (override: "))
            )
            note = F.concat(F.lit(f"{c}: "), F.coalesce(plain_number(F.col(c)), F.lit("None")), said, o["source"], F.lit(")"))
        hit = F.coalesce(hit, F.lit(False))
        new[c] = F.when(hit, value).otherwise(F.col(c))
        notes.append(F.when(hit, note))
    noted = F.concat_ws("; ", *notes)
    reason = F.concat_ws("; ", "review_reason", F.when(noted != "", F.concat(F.lit("overrides_applied: "), noted)))
    return s.withColumns(new | {"review_reason": F.nullif(reason, F.lit(""))}).drop("_o")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id, others stay; a row with an admin decision keeps its review columns."""
    keep = old.where("admin_decision is not null").select(F.col("id").alias("_k"), F.col("needs_review").alias("_n"), F.col("review_reason").alias("_r"), "admin_decision")
    fresh = new.join(keep, F.col("id") == F.col("_k"), "left")
    decided = F.col("admin_decision").isNotNull()
    fresh = fresh.withColumns({"needs_review": F.when(decided, F.col("_n")).otherwise(F.col("needs_review")), "review_reason": F.when(decided, F.col("_r")).otherwise(F.col("review_reason"))})
    return old.join(new.select("id"), "id", "left_anti").unionByName(fresh.drop("_k", "_n", "_r"), allowMissingColumns=True)


def retire_orphans(merged: DataFrame, live: DataFrame) -> DataFrame:
    """Rows without a source in this sweep and known to be garbage are flagged, never deleted; imported and reviewed rows stay."""
    reason = F.coalesce("review_reason", F.lit(""))
    garbage = reason.rlike("|".join(GARBAGE)) | formulas.invalid_reason(F.regexp_replace(F.coalesce("formula", F.lit("")), r"(?U)\s+", "")).isNotNull()
    here = live.select(F.col("id").alias("_k")).distinct()
    rows = merged.join(here, F.col("id") == F.col("_k"), "left")
    hit = F.col("_k").isNull() & ~F.col("needs_review") & F.col("admin_decision").isNull() & ~F.col("id").startswith("nims:") & garbage
    said = F.concat(F.lit("orphaned_invalid_source; was: "), F.coalesce("review_reason", F.lit("(none)")))
    return rows.withColumns({"review_reason": F.when(hit, F.when(F.char_length(said) <= 200, said)).otherwise(F.col("review_reason")), "needs_review": F.col("needs_review") | hit}).drop("_k")


def scorecard(s: DataFrame) -> DataFrame:
    """(metric, value): what is doubtful in a run of summaries (columns as summarise() gives them)."""
    shown, mark = F.col("formula"), formulas.signature(F.col("formula"))
    bad = formulas.invalid_reason(F.regexp_replace(F.coalesce(shown, F.lit("")), r"(?U)\s+", "")).isNotNull()
    theory_only = F.col("tc_max_experimental").isNull() & F.col("tc_max_theoretical").isNotNull() & (F.col("dominant_evidence") == "experimental")
    counts = stack_metrics(s, {
        "rows": F.count("*"), "needs_review": F.count_if("needs_review"), "visible": F.count_if(~F.col("needs_review")), "rejectable": F.count_if(bad),
        "theory_headline": F.count_if(theory_only), "phase_inconsistent": F.count_if(F.col("structure_phase").isNotNull() & phase_checked(F.col("structure_phase"), shown).isNull()),
        "null_family_with_papers": F.count_if(F.col("family").isNull() & (F.col("total_papers") > 0)),
    })
    groups = s.where(mark != "").groupBy(mark.alias("mark")).agg(F.min("formula_normalized").alias("low"), F.max("formula_normalized").alias("high"))
    return counts.unionByName(stack_metrics(groups.where("low <> high"), {"near_duplicate_clusters": F.count("*")}))


def link_variants(s: DataFrame, key: str = "formula_normalized", id: str = "id") -> DataFrame:
    """parent_id of variants whose parent is there, and variant_count of parents."""
    rows = s.withColumn("_p", formulas.parent_key(F.col(key)))
    ids = s.select(F.col(key).alias("_pk"), F.col(id).alias("parent_id"))
    linked = rows.join(ids, (F.col("_p") == F.col("_pk")) & (F.col("_p") != F.col(key)), "left").drop("_pk", "_p")
    counts = linked.where("parent_id is not null").groupBy(F.col("parent_id").alias("_v")).agg(F.count("*").alias("variant_count"))
    return linked.join(counts, F.col(id) == F.col("_v"), "left").drop("_v")
