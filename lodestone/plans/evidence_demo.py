"""The evidence pipeline end to end on the test tables: orders as papers, their lines as extracted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import formulas
from lodestone.operators import rules, summary, timeline
from lodestone.session import materialised

from .registry import query

#: Entities of the demonstration; a part stands for one of them in one of several spellings.
FORMULAS = [
    "MgB2", "YBa2Cu3O7", "YBa2Cu3O6.95", "YBCO", "Bi2Sr2CaCu2O8", "BSCCO", "La1.85Sr0.15CuO4", "HgBa2CuO4", "LaFeAsO", "FeSe", "FeSe/SrTiO3",
    "BaFe2As2", "LiFeAs", "NbSe2", "2H-NbSe2", "Nb3Sn", "Nb3Ge", "V3Si", "CsV3Sb5", "Sr2RuO4", "UTe2", "CeCoIn5", "CeCu2Si2", "LaH10", "H3S", "YH9",
    "K3C60", "Cs3C60", "Ba0.6K0.4BiO3", "LaO0.5F0.5BiS2", "YNi2B2C", "La3Ni2O7", "NdNiO2", "NbTi", "NbN", "TaS2", "PdTe2", "SnTe", "In", "Pb", "GaAs",
    "LaMnO3Sr", "BaTiO3", "Sr-Ru-O", "H", "Fm-3m-CeH10",
]
DOUBLES = [
    "lattice_a", "lattice_c", "t_cdw_k", "t_sdw_k", "t_afm_k", "rho_exponent", "hc2_tesla", "lambda_eph", "omega_log_k", "rho_s_mev", "doping_level",
]
TEXTS = [
    "paper_type", "tc_regime", "family", "gap_structure", "crystal_structure", "structure_phase", "competing_order", "hc2_conditions", "substrate",
    "pressure_type", "doping_type",
]


def _line() -> Column:
    """What a record is made of, in numbers: lines are shuffled as these, and become records only where those of a paper have come together."""
    c, whole = F.col, lambda x: x.cast("int")
    return F.struct(
        whole(c("l_partkey") % len(FORMULAS)).alias("formula"), whole(c("l_linenumber")).alias("number"), whole(c("l_suppkey") % 28).alias("supplier"), c("l_quantity").alias("tc"),
        F.when(c("l_tax") > 0.06, c("l_tax") * 1000).alias("pressure"), (c("l_discount") * 10).alias("confidence"), F.when(c("l_returnflag") == "R", 0).when(c("l_returnflag") == "A", 1).alias("evidence"),
        (c("l_linestatus") == "F").alias("ambient"), (c("l_extendedprice") / 1000).alias("value"),
    )


def _record(r: Column) -> Column:
    """A line as the record that was extracted."""
    one = lambda names, at: F.get(F.array(*map(F.lit, names)), at)
    number, supplier = r["number"], r["supplier"]
    return F.struct(
        one(FORMULAS, r["formula"]).alias("formula"), r["tc"].alias("tc_kelvin"), r["pressure"].alias("pressure_gpa"), one(("resistivity", "dft", "unknown"), number % 3).alias("measurement"),
        r["confidence"].alias("confidence"), one(("cited", "primary_experimental"), r["evidence"]).alias("evidence_type"), r["ambient"].alias("ambient_sc"),
        one(("s-wave", "d-wave", "D-wave", ""), supplier % 4).alias("pairing_symmetry"), F.when(number == 1, "P6/mmm").alias("space_group"), one(("film", "bulk"), number % 2).alias("sample_form"),
        F.lit(None).cast("boolean").alias("is_unconventional"),
        F.lit(None).cast("boolean").alias("disputed"),
        *[F.when(supplier % 7 == k % 7, r["value"]).alias(c) for k, c in enumerate(DOUBLES)],
        *[F.lit(None).cast("string").alias(c) for c in TEXTS],
    )


def papers(t) -> DataFrame:
    """papers with their nested records, deterministic from orders and lineitem."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(_line()).alias("lines"))
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(
        F.concat(F.when(F.col("o_orderkey") % 50 == 0, "aps:10.1103/").otherwise("arxiv:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderkey") % 50 == 0, "aps").otherwise("arxiv").alias("source"),
        F.when(F.col("o_orderstatus") == "P", "retracted").alias("status"),
        F.concat(F.lit("T"), F.substring("o_orderpriority", 1, 1)).alias("credibility_tier"),
        F.to_date("o_orderdate").alias("date_submitted"), F.lit(None).cast("date").alias("date_published"),
        F.lit(None).cast("string").alias("paper_type"), F.lit(None).cast("string").alias("doi"), F.lit(0).alias("citation_count"),
        F.lit(None).cast("array<string>").alias("categories"),
        F.sort_array(F.transform("lines", _record)).alias("materials_extracted"),  # after the join: only papers that a caller keeps get records
    )


def written(t) -> DataFrame:
    """The papers that count, written: the others would be written only to be left out of every record."""
    return materialised(summary.counting(papers(t)).drop("tier", "factor"), "papers")


# What the formulas above come to, in their order: key, reason of refusal, family.
FACTS = (
    ("mgb2", None, "mgb2"), ("yba2cu3o7", None, "cuprate"), ("yba2cu3o6.95", None, "cuprate"), ("yba2cu3o7", None, "cuprate"), ("bi2sr2cacu2o8", None, "cuprate"),
    ("bi2sr2cacu2o8", None, "cuprate"), ("la1.85sr0.15cuo4", None, "cuprate"), ("hgba2cuo4", None, "cuprate"), ("lafeaso", None, "iron_based"), ("fese", None, "iron_based"),
    ("fese/srtio3", None, "iron_based"), ("bafe2as2", None, "iron_based"), ("lifeas", None, "iron_based"), ("nbse2", None, "chalcogenide"), ("nbse2", "invalid_start", "chalcogenide"),
    ("nb3sn", None, "conventional"), ("nb3ge", None, "conventional"), ("v3si", None, "conventional"), ("csv3sb5", None, "kagome"), ("sr2ruo4", None, "ruthenate"),
    ("ute2", None, "heavy_fermion"), ("cecoin5", None, "heavy_fermion"), ("cecu2si2", None, "heavy_fermion"), ("lah10", None, "hydride"), ("h3s", None, "hydride"),
    ("yh9", None, "hydride"), ("k3c60", None, "fulleride"), ("cs3c60", None, "fulleride"), ("ba0.6k0.4bio3", None, "bismuthate"), ("lao0.5f0.5bis2", None, "bis2_layered"),
    ("yni2b2c", None, "borocarbide"), ("la3ni2o7", None, "nickelate"), ("ndnio2", None, "nickelate"), ("nbti", None, "conventional"), ("nbn", None, "conventional"),
    ("tas2", None, "chalcogenide"), ("pdte2", None, "chalcogenide"), ("snte", None, "chalcogenide"), ("in", None, "elemental"), ("pb", None, "elemental"), ("gaas", None, None),
    ("lamno3sr", None, None), ("batio3", None, "conventional"), ("srruo", "system_designator_not_compound", None), ("h", "single_element_symbol", None), ("fm-3mceh10", "phase_prefix_in_formula", "hydride"),
)

_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_names = ", ".join(f"({i}, '{f}', {', '.join(map(_quoted, facts))})" for i, (f, facts) in enumerate(zip(FORMULAS, FACTS)))
#: The papers and records that papers() makes, and what records() says of them, in DuckDB SQL.
RECORDS_SQL = f"""
forms(i, formula, key, reason, family) AS (VALUES {_names}),
every AS (
 SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'aps:10.1103/' ELSE 'arxiv:' END || o_orderkey AS paper_id, CASE WHEN o_orderkey % 50 = 0 THEN 'aps' ELSE 'arxiv' END AS source,
  o_orderstatus = 'P' AS retracted, CASE WHEN o_orderkey % 50 = 0 THEN 'T1' ELSE 'T' || o_orderpriority[1] END AS tier, year(o_orderdate) AS year,
  formula, key, reason, forms.family AS rule, l_quantity::DOUBLE AS tc, CASE WHEN l_tax > 0.06 THEN l_tax * 1000 END AS pressure, ['resistivity', 'dft', 'unknown'][l_linenumber % 3 + 1] AS measurement,
  l_discount * 10 AS given, CASE l_returnflag WHEN 'R' THEN 'cited' WHEN 'A' THEN 'primary_experimental' END AS evidence, l_linestatus = 'F' AS ambient,
  ['s-wave', 'd-wave', 'D-wave', ''][l_suppkey % 4 + 1] AS pairing, ['film', 'bulk'][l_linenumber % 2 + 1] AS form,
  CASE WHEN l_suppkey % 7 = 5 THEN l_extendedprice / 1000 END AS rho_exponent, CASE WHEN l_suppkey % 7 = 6 THEN l_extendedprice / 1000 END AS hc2_tesla,
  CASE WHEN l_suppkey % 7 = 0 THEN l_extendedprice / 1000 END AS lattice_a, CASE WHEN l_suppkey % 7 = 1 THEN l_extendedprice / 1000 END AS lattice_c, CASE WHEN l_linenumber = 1 THEN 'P6/mmm' ELSE '' END AS grp
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN forms ON l_partkey % {len(FORMULAS)} = i),
live AS (
 SELECT *, CASE WHEN tier = 'T3' THEN round(given * 0.8, 3) ELSE given END AS confidence, CASE WHEN reason IS NOT NULL THEN reason WHEN evidence = 'cited' THEN 'cited'
  WHEN given < 0.3 THEN 'low_confidence' WHEN tc NOT BETWEEN 0.01 AND 300 THEN 'tc_out_of_range' END AS skip FROM every WHERE NOT retracted AND tier NOT IN ('T4', 'T5')),
kept AS (SELECT *, CASE WHEN evidence = 'primary_experimental' THEN false ELSE measurement = 'dft' END AS theory FROM live WHERE skip IS NULL)"""


@query()
def evidence_summary(t, spark):
    """Papers to summaries: flatten, vote, review, link variants. evidence_headline holds its columns against SQL."""
    flat = summary.records(written(t)).where("skip is null")
    return summary.link_variants(summary.summarise(flat)).drop("lattice_params")


_ceilings = ", ".join(f"('{k}', {v})" for k, v in summary.FAMILY_CEILING.items())


@query(f"""WITH {RECORDS_SQL}, ceilings(family, ceiling) AS (VALUES {_ceilings}),
top AS (SELECT key, kind, v, reach, n FROM (
  SELECT key, kind, v, count(*) OVER (PARTITION BY key, kind ORDER BY v DESC) AS reach, count(*) OVER (PARTITION BY key, kind) AS n FROM (
   SELECT key, kind, paper_id, max(tc) AS v FROM (SELECT *, 'exp' AS kind FROM kept WHERE NOT theory UNION ALL SELECT *, 'theo' FROM kept WHERE theory UNION ALL SELECT *, 'amb' FROM kept WHERE ambient AND NOT theory) GROUP BY 1, 2, 3))
 WHERE reach >= CASE WHEN n < 5 THEN 1 ELSE greatest(2, least(10, n // 20)) END),
best AS (SELECT key, max(v) FILTER (kind = 'exp') AS e, max(v) FILTER (kind = 'theo') AS th, max(v) FILTER (kind = 'amb') AS am FROM top GROUP BY 1),
ballots AS (
 SELECT key, field, lower(said) AS k, said, paper_id, least(1, greatest(0, confidence)) AS w FROM (SELECT key, 'pairing' AS field, pairing AS said, paper_id, confidence FROM kept UNION ALL SELECT key, 'form', form, paper_id, confidence FROM kept)),
votes AS (SELECT key, field, k, sum(w) AS w, count(DISTINCT paper_id) AS voters FROM ballots GROUP BY 1, 2, 3),
spelled AS (SELECT key, field, k, arg_max(said, (c, said)) AS said FROM (SELECT key, field, k, said, count(*) AS c FROM ballots GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
won AS (
 SELECT b.key, arg_min(CASE WHEN ok THEN b.said END, o) FILTER (b.field = 'pairing') AS pairing_symmetry, arg_min(CASE WHEN ok THEN b.said END, o) FILTER (b.field = 'form') AS sample_form FROM (
  SELECT v.key, v.field, spelled.said, (n < 2 OR voters >= 2) AND (total <= 0 OR round(w / total, 9) >= 0.6) AS ok, (-round(w, 9), v.k) AS o
  FROM votes v JOIN spelled USING (key, field, k) JOIN (SELECT key, field, count(*) AS n, sum(w) FILTER (k <> '') AS total FROM ballots GROUP BY 1, 2) USING (key, field) WHERE v.k <> '') b GROUP BY 1),
flag AS (SELECT key, sum(least(1, greatest(0, confidence))) FILTER (ambient) AS t, sum(least(1, greatest(0, confidence))) AS w, bool_or(ambient) AS any_ambient FROM kept GROUP BY 1),
named AS (SELECT key, arg_min(formula, (-c, length(formula), formula)) AS formula, arg_min(rule, (-c, length(formula), formula)) AS family FROM (SELECT key, formula, rule, count(*) AS c FROM kept GROUP BY 1, 2, 3) GROUP BY 1),
base AS (
 SELECT key, count(DISTINCT paper_id) AS total_papers, min(year) AS arxiv_year, min(tier) AS best_credibility_tier, max(hc2_tesla) AS hc2_tesla, median(rho_exponent) AS rho_exponent,
  coalesce(count(tc) FILTER (ambient AND NOT theory) >= 2 AND (max(tc) FILTER (ambient AND NOT theory) - min(tc) FILTER (ambient AND NOT theory)) / max(tc) FILTER (ambient AND NOT theory) > 0.3, false) AS disputed,
  CASE WHEN count(*) FILTER (NOT theory) / count(*) >= 0.75 THEN 'experimental' WHEN count(*) FILTER (theory) / count(*) >= 0.75 THEN 'theoretical' ELSE 'mixed' END AS dominant_evidence FROM kept GROUP BY 1)
, firsts AS (SELECT key, arg_min(lattice_a, o) AS lattice_a, arg_min(lattice_c, o) AS lattice_c FROM (
  SELECT key, coalesce(lattice_a, -1) AS lattice_a, coalesce(lattice_c, -1) AS lattice_c, (paper_id, formula, tc, coalesce(pressure, -1), measurement, given, coalesce(evidence, ''), ambient, pairing, grp, form) AS o FROM kept WHERE lattice_a IS NOT NULL OR lattice_c IS NOT NULL) GROUP BY 1)
SELECT 'mat:' || key AS id, formula, family, round_even(greatest(coalesce(e, th), am), 3) AS tc_max, round_even(e, 3) AS tc_max_experimental, round_even(th, 3) AS tc_max_theoretical,
 round_even(least(am, greatest(coalesce(e, th), am)), 3) AS tc_ambient, dominant_evidence, CASE WHEN any_ambient THEN true WHEN (w - coalesce(flag.t, 0)) / w >= 0.7 THEN false END AS ambient_sc, arxiv_year::INTEGER AS arxiv_year, total_papers,
 CASE WHEN family = 'cuprate' AND pairing_symmetry IS NULL THEN 'd-wave' ELSE pairing_symmetry END AS pairing_symmetry, sample_form, round_even(hc2_tesla, 3) AS hc2_tesla, round_even(rho_exponent, 3) AS rho_exponent,
 disputed, best_credibility_tier, nullif(a.lattice_a, -1) AS lattice_a, nullif(a.lattice_c, -1) AS lattice_c, reason AS review_reason, reason IS NOT NULL AS needs_review
FROM base JOIN best USING (key) JOIN won USING (key) JOIN flag USING (key) JOIN named USING (key) LEFT JOIN firsts a USING (key) LEFT JOIN ceilings USING (family),
 LATERAL (SELECT greatest(coalesce(e, th), am) AS t) x, LATERAL (SELECT CASE WHEN x.t > ceiling THEN 'tc_max_' || printf('%.1f', x.t) || '_implausible_for_' || family || '_ceiling_' || printf('%.0f', ceiling) || 'K'
  WHEN family IS NULL AND x.t > 45 THEN 'tc_max_' || printf('%.1f', x.t) || '_implausible_for_null_family_ceiling_45K' WHEN formula = 'LaMnO3Sr' THEN 'non_sc_material_suspected: CMR/AFM manganite'
  WHEN formula = 'BaTiO3' THEN 'non_sc_material_suspected: ferroelectric/insulator' END AS reason) y""")
def evidence_headline(t, spark):
    """The voted, quorate and counted columns of the summaries."""
    s = summary.summarise(summary.records(written(t)).where("skip is null"))
    return s.select("id", "formula", "family", "tc_max", "tc_max_experimental", "tc_max_theoretical", "tc_ambient", "dominant_evidence", "ambient_sc", "arxiv_year", "total_papers", "pairing_symmetry",
                    "sample_form", "hc2_tesla", "rho_exponent", "disputed", "best_credibility_tier", F.col("lattice_params.a").alias("lattice_a"), F.col("lattice_params.c").alias("lattice_c"), "review_reason", "needs_review")


@query(f"WITH {RECORDS_SQL} SELECT skip, count(*) AS n FROM live GROUP BY 1")
def evidence_skips(t, spark):
    """How many records each reason leaves out."""
    return summary.records(written(t)).groupBy("skip").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS_SQL},
per AS (
 SELECT paper_id, any_value(source) AS source, any_value(retracted) AS retracted, count(*) AS n, count(DISTINCT formula) AS forms, count(*) FILTER (formula <> 'GaAs') AS standing,
  count(*) FILTER (evidence = 'primary_experimental') AS prim, count(*) FILTER (evidence = 'cited') AS cited, avg(given) AS conf, count(*) FILTER (tc > 0) AS tcs,
  count(*) FILTER (tc > 0 AND tc > 1.2 * CASE WHEN formula = 'MgB2' THEN 42 ELSE 300 END) AS odd FROM every GROUP BY 1),
r AS (SELECT *, coalesce(odd / nullif(tcs, 0), 0) AS rate, prim / n AS primary_, cited / n AS cites FROM per)
SELECT paper_id AS id, x[1:2] AS tier, x[4:] AS reason FROM (SELECT paper_id, CASE
 WHEN retracted THEN 'T5 retracted' WHEN source = 'aps' THEN 'T1 aps_published_article' WHEN standing = 0 THEN 'T5 all_formulas_refuted' WHEN rate > 0.8 THEN 'T5 anomaly_rate=' || round(rate * 100)::INT || '%'
 WHEN forms > 30 THEN 'T4 review_paper_' || forms || '_formulas' WHEN rate > 0.3 THEN 'T4 high_anomaly_rate=' || round(rate * 100)::INT || '%' WHEN prim = 0 AND n > 5 THEN 'T4 no_primary_evidence_many_records'
 WHEN forms <= 3 AND primary_ >= 0.8 AND round(conf, 9) >= 0.8 AND rate = 0 AND n <= 10 THEN 'T1 focused_experimental' WHEN forms <= 10 AND rate = 0 THEN 'T2 normal' WHEN forms <= 10 AND rate <= 0.1 THEN 'T2 minor_anomaly=' || round(rate * 100)::INT || '%'
 WHEN primary_ >= 0.5 AND forms <= 15 THEN 'T2 mostly_primary' WHEN forms > 10 THEN 'T3 many_formulas_' || forms WHEN cites > 0.5 THEN 'T3 mostly_cited=' || round(cites * 100)::INT || '%'
 WHEN round(conf, 9) < 0.6 THEN 'T3 low_confidence=' || format('{{:.2f}}', conf) ELSE 'T2 default' END AS x FROM r)""")
def credibility_tiers(t, spark):
    """The tier of every paper and why."""
    over = spark.createDataFrame([("mgb2", "tc_max", "42", True, "book")], "canonical string, field string, override_value string, is_cap boolean, source string")
    return rules.credibility(papers(t), over, spark.createDataFrame([("gaas",)], "canonical string"))


def with_records(t, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers that count, or every one; a small table of summaries; and their records, a row each."""
    p = materialised(papers(t), "papers") if every else written(t)
    flat = summary.records(p).where("skip is null").withColumn("id", F.concat(F.lit("mat:"), F.col("key")))
    flat = materialised(
        flat.select("id", F.struct("paper_id", "ord").alias("place"), "key", "shown", "paper_id", "pressure_gpa", "tc_kelvin", "ambient_sc", "year", "measurement", "paper_type", "tier"), "flat"
    )
    sizes = flat.groupBy("id", "paper_id").agg(F.lit(1).alias("_one")).groupBy("id").agg(F.count("*").alias("total_papers"))
    m = flat.groupBy("id").agg(F.min("shown").alias("formula"), F.min("key").alias("formula_normalized"), F.max("tc_kelvin").alias("tc_max"), F.max("ambient_sc").alias("ambient_sc"), F.min("year").alias("arxiv_year"))
    fam = formulas.family(F.col("formula"))
    m = materialised(m, "materials").join(sizes, "id", "left").withColumns({"family": fam, "is_unconventional": formulas.unconventional(fam), "needs_review": F.lit(False), "review_reason": F.lit(None).cast("string"), "admin_decision": F.lit(None).cast("string")})
    return p, m, flat.drop("key", "shown")


_audit = ", ".join(f"('{k}', {v})" for k, v in rules.AUDIT_CAPS.items())


@query(f"""WITH {RECORDS_SQL}, caps(family, cap) AS (VALUES {_audit}),
big AS (SELECT paper_id FROM every GROUP BY 1 HAVING count(*) >= 15),
firsts AS (SELECT key, min(formula) AS f FROM kept GROUP BY 1),
m AS (
 SELECT k.key, any_value(forms.family) AS family, max(tc) AS tc_max, bool_or(ambient) AS ambient_sc, count(DISTINCT paper_id) AS papers, min(year) AS first_year, max(year) AS last_year, min(paper_id) AS first_paper,
  coalesce(bool_or(pressure < 0 OR pressure > 500), false) AS squeezed, coalesce(bool_or(tc > 100 AND pressure < 50), false) AS hot, coalesce(bool_or(ambient AND pressure > 1), false) AS pressed,
  bool_or(year < 1980 OR year > 2025) AS odd_year FROM kept k JOIN firsts USING (key) JOIN forms ON forms.formula = firsts.f GROUP BY 1),
f AS (SELECT m.*, CASE WHEN tc_max > cap THEN 'tc_exceeds_family_cap' WHEN ambient_sc AND tc_max > 152 THEN 'tc_at_ambient_above_record' WHEN squeezed THEN 'implausible_pressure'
  WHEN m.family = 'hydride' AND hot THEN 'hydride_low_pressure_high_tc' WHEN pressed THEN 'ambient_sc_with_high_pressure' END AS early,
 CASE WHEN papers = 1 AND tc_max > 80 AND first_paper IN (FROM big) THEN 'citation_conflation_review_paper' WHEN key = 'fese' AND tc_max > 37 THEN 'tc_exceeds_compound_cap' END AS late
 FROM m LEFT JOIN caps ON caps.family = m.family)
SELECT 'mat:' || key AS id, early IS NOT NULL OR late IS NOT NULL AS needs_review, coalesce(early, late) AS review_reason,
 concat_ws(',', CASE WHEN early IS NULL AND odd_year THEN 'record_year_out_of_range' END, CASE WHEN early IS NULL AND last_year - 5 > first_year THEN 'arxiv_year_mismatch' END) AS counted FROM f""")
def audit_rules(t, spark):
    """The eleven audit rules over summaries with their records."""
    p, m, flat = with_records(t, every=True)
    over = spark.createDataFrame([("fese", "tc_max", "37", True, "book")], "canonical string, field string, override_value string, is_cap boolean, source string")
    after = rules.run(m, rules.standard(p, over, 2024, flat))
    return after.select("id", "needs_review", "review_reason", F.array_join("counted", ",").alias("counted"))


@query(f"""WITH {RECORDS_SQL}, firsts AS (SELECT key, min(formula) AS f FROM kept GROUP BY 1), f AS (SELECT firsts.key, family FROM firsts JOIN forms ON forms.formula = firsts.f)
SELECT DISTINCT 'mat:' || key AS id, f.family, year::INTEGER AS year, round_even(tc, 1) AS tc_kelvin, round_even(pressure, 0) AS pressure_gpa, measurement = 'dft' AS is_theoretical
FROM kept JOIN f USING (key) WHERE tc > 0 AND tc <= 300 AND year BETWEEN 1900 AND 2025""")
def timeline_points(t, spark):
    """The points of the time-line, values to 0.1 and whole pressures."""
    p, m, flat = with_records(t)
    pts = timeline.points(m, p, 2024, records=flat)
    return pts.select("id", "family", "year", F.bround("tc_kelvin", 1).alias("tc_kelvin"), F.bround("pressure_gpa", 0).alias("pressure_gpa"), "is_theoretical")
