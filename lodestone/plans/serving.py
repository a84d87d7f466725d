"""Pages of summaries, resumed enrichment, look-ups and spot checks on whole test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import audits, enrichment, rules, spotchecks, views
from lodestone.operators.vector_index import fresh_path
from lodestone.session import materialised

from .registry import query

# A part is a summary; the first part of its brand and type is its parent.
PAGES_SQL = """
m AS (
 SELECT 'mat:' || p_partkey AS id, CASE WHEN p_partkey <> min(p_partkey) OVER (PARTITION BY p_brand, p_type) THEN 'mat:' || min(p_partkey) OVER (PARTITION BY p_brand, p_type) END AS parent_id,
  p_name || ' ' || p_partkey AS formula, CASE WHEN p_size % 9 <> 0 THEN p_retailprice END AS tc_max, CASE WHEN p_size % 2 = 0 THEN p_size / 50.0::DOUBLE END AS doping_level,
  CASE p_size WHEN 7 THEN 'provenance_quarantine_nims' WHEN 8 THEN 'odd' END AS review_reason FROM part),
pages AS (SELECT id FROM m WHERE review_reason IS DISTINCT FROM 'provenance_quarantine_nims')"""


def summaries(t):
    p = t("part")
    first = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    size = F.col("p_size")
    return p.join(first, ["p_brand", "p_type"]).select(
        F.concat(F.lit("mat:"), "p_partkey").alias("id"), F.when(F.col("first") != F.col("p_partkey"), F.concat(F.lit("mat:"), "first")).alias("parent_id"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("formula"), F.when(size % 9 != 0, F.col("p_retailprice")).alias("tc_max"), F.when(size % 2 == 0, size / 50.0).alias("doping_level"),
        F.when(size == 7, "provenance_quarantine_nims").when(size == 8, "odd").alias("review_reason"), (size == 8).alias("needs_review"),
    )


@query(f"""WITH {PAGES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY tc_max DESC NULLS LAST, id) AS n FROM m WHERE parent_id IS NOT NULL),
v AS (SELECT parent_id, count(*) AS variant_count, count(*) FILTER (n <= 100) AS shown, string_agg(formula || ':' || coalesce(tc_max::DECIMAL(18, 2)::VARCHAR, ''), ',' ORDER BY n) FILTER (n <= 100) AS variants FROM r GROUP BY 1)
SELECT id, coalesce(variant_count, 0) AS variant_count, coalesce(shown, 0) AS shown, coalesce(variants, '') AS variants FROM pages LEFT JOIN v ON parent_id = id""")
def material_details(t, spark):
    """Every summary that has a page, with its hundred variants of highest value."""
    d = views.detail(summaries(t))
    line = F.transform("variants", lambda v: F.concat(v["formula"], F.lit(":"), F.coalesce(v["tc_max"].cast("decimal(18,2)").cast("string"), F.lit(""))))
    return d.select("id", "variant_count", F.size("variants").cast("long").alias("shown"), F.array_join(line, ",").alias("variants"))


@query(f"""WITH {PAGES_SQL},
members AS (SELECT id AS page_id, id, formula, doping_level, false AS variant FROM m UNION ALL SELECT parent_id, id, formula, doping_level, true FROM m WHERE parent_id IS NOT NULL)
SELECT page_id, variant, formula, l_quantity - 2 AS tc_kelvin, coalesce(CASE WHEN l_tax > 0.03 THEN l_discount END, doping_level) AS doping_level, CASE WHEN l_discount > 0.02 THEN l_tax * 1000 END AS pressure_gpa,
 'p:' || l_orderkey AS paper_id, year(l_shipdate)::INTEGER AS year FROM members JOIN lineitem ON id = 'mat:' || l_partkey WHERE page_id IN (FROM pages) AND l_quantity > 2""")
def phase_diagrams(t, spark):
    """The points of all phase diagrams: a summary's own records and those of its variants."""
    r = t("lineitem").select(
        F.concat(F.lit("mat:"), "l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber").alias("place"), (F.col("l_quantity") - 2).alias("tc_kelvin"),
        F.when(F.col("l_tax") > 0.03, F.col("l_discount")).alias("doping_level"), F.when(F.col("l_discount") > 0.02, F.col("l_tax") * 1000).alias("pressure_gpa"),
        F.concat(F.lit("p:"), "l_orderkey").alias("paper_id"), F.year("l_shipdate").alias("year"),
    )
    return views.phase_points(summaries(t), r).drop("place")


@query(f"""WITH {PAGES_SQL},
h AS (SELECT 'h:' || l_orderkey || '-' || l_linenumber AS record_key, 'mat:' || l_partkey AS material_id, CASE WHEN l_tax > 0.01 THEN l_tax * 1000 END AS pressure_gpa, CASE WHEN l_discount > 0.01 THEN l_quantity END AS tc_kelvin,
 CASE WHEN l_linenumber > 1 THEN year(l_shipdate)::INTEGER END AS year FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY pressure_gpa NULLS LAST, tc_kelvin DESC NULLS LAST, year DESC NULLS LAST, record_key) AS n FROM h WHERE material_id IN (FROM pages))
SELECT ((n - 1) // 50 + 1)::INTEGER AS page, record_key, pressure_gpa, tc_kelvin, year FROM r WHERE n <= 150""")
def hydride_pages(t, spark):
    """The first three pages of hydride rows, each from the last row of the one before."""
    h = t("lineitem").select(
        F.concat(F.lit("h:"), "l_orderkey", F.lit("-"), "l_linenumber").alias("record_key"), F.concat(F.lit("mat:"), "l_partkey").alias("material_id"),
        F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 1000).alias("pressure_gpa"), F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("tc_kelvin"),
        F.when(F.col("l_linenumber") > 1, F.year("l_shipdate")).alias("year"),
    )
    rows = views.hydride_rows(summaries(t), h).select("record_key", "pressure_gpa", "tc_kelvin", "year")
    pages, last = [], None
    for k in range(1, 4):
        page = views.page_after(rows, views.HYDRIDE_ORDER, last)
        seen = page.collect()  # a page is 50 rows
        last = seen[-1].asDict() if seen else None
        pages.append(page.withColumn("page", F.lit(k)))
        if not last:
            break
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def _lines(row: dict) -> list[dict]:
    """The records of a paper, one a line of its text; a paper under review can't be read."""
    if row["status"] == "P" and row["patience"] < 2:
        raise ValueError("under review")
    found = []
    for line in row["said"].split(";"):
        formula, tc, pressure, coupling, confidence = line.split("|")
        found.append({"formula": formula, "tc_kelvin": tc, "pressure_gpa": pressure or None, "lambda_eph": coupling or None, "confidence": confidence, "evidence_type": "cited"})
    return found


@query("""
WITH l AS (SELECT l_orderkey, ['LaH10', 'CaH6', 'H3S'][l_linenumber % 3 + 1] AS formula, l_quantity * 10 - 20 AS tc, CASE WHEN l_tax > 0.02 THEN l_tax * 9000 END AS p, CASE WHEN l_discount > 0.03 THEN l_discount * 130 END AS lam,
 l_linenumber AS n, l_linenumber / 10.0::DOUBLE AS confidence FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, formula, tc, p, lam ORDER BY confidence DESC) AS k FROM l
 WHERE tc BETWEEN 0.01 AND 400 AND (p IS NULL OR p BETWEEN 0 AND 500) AND (lam IS NULL OR lam BETWEEN 0.01 AND 10) AND (p IS NOT NULL OR lam IS NOT NULL)),
g AS (SELECT l_orderkey, count(*) AS n, sum(confidence) AS c, sum(tc) AS tc FROM f WHERE k = 1 GROUP BY 1),
o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderstatus = 'P' AND o_custkey % 2 = 0 AS failed FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT 'p:' || o_orderkey AS paper_id, NOT failed AS ok, CASE WHEN failed THEN 'ValueError: under review' END AS error, CASE WHEN failed THEN 0 ELSE coalesce(n, 0) END AS n_records, CASE WHEN NOT failed AND n > 0 THEN round(c, 6) END AS confidence,
 CASE WHEN NOT failed AND n > 0 THEN round(tc, 6) END AS tc, CASE WHEN NOT failed AND n > 0 THEN y::INTEGER END AS year FROM o LEFT JOIN g ON l_orderkey = o_orderkey""")
def enrichment_resumed(t, spark):
    """Hydride parameters of every paper: a first run on which papers fail, and a second one that asks only those again and is patient with some."""
    n = F.col("l_linenumber")
    text = F.concat_ws(
        "|", F.element_at(F.array(F.lit("LaH10"), F.lit("CaH6"), F.lit("H3S")), (n % 3 + 1).cast("int")), F.col("l_quantity") * 10 - 20, F.coalesce(F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 9000).cast("string"), F.lit("")),
        F.coalesce(F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 130).cast("string"), F.lit("")), n / 10,
    )
    said = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("said"))
    papers = t("orders").join(said, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("p:"), "o_orderkey").alias("id"), F.lit("arxiv").alias("source"), F.lit(None).cast("string").alias("doi"), F.lit("A hydride").alias("title"), F.lit(None).cast("string").alias("abstract"),
        F.to_date("o_orderdate").alias("date_submitted"), F.lit(None).cast("date").alias("date_published"), "said", F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 2).alias("odd"),
    )
    papers = materialised(enrichment.candidates(papers), "papers")
    path = fresh_path(spark, "enrichment")
    materials = spark.createDataFrame([("mat:lah10", "lah10")], "id string, formula_normalized string")
    enrichment.run(papers.withColumn("patience", F.lit(0)), materials, _lines, path, "first", rounds=1)
    enrichment.run(papers.withColumn("patience", F.col("odd") * 2), materials, _lines, path, "second", rounds=1, retry_failed=True)
    found, events = enrichment.tables(spark, path)
    sums = found.read().groupBy("paper_id").agg(F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.sum("tc_kelvin"), 6).alias("tc"), F.max("year").alias("year"))
    return events.read().join(sums, "paper_id", "left").select("paper_id", "ok", "error", "n_records", "confidence", "tc", "year")


@query("""
WITH m AS (SELECT 'mat:' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Nb' || p_partkey || '_Sn' WHEN 1 THEN p_name WHEN 2 THEN 'La' || p_size || '.5O' ELSE 'V_' || p_partkey END AS formula,
 CASE WHEN p_size % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(p_size) END AS stamp FROM part),
d AS (SELECT *, stamp IS NULL OR stamp < TIMESTAMP '2024-02-20' - INTERVAL 30 DAY AS due, CASE WHEN id[5:]::BIGINT % 4 IN (0, 3) THEN replace(formula, '_', '') END AS asks FROM m),
h AS (SELECT CASE l_partkey % 4 WHEN 0 THEN 'Nb' || l_partkey || 'Sn' ELSE 'V' || l_partkey END AS formula, 'mp-' || l_orderkey || '-' || l_linenumber AS hit, CASE WHEN l_tax > 0.03 THEN l_tax END AS e
 FROM lineitem WHERE l_partkey % 4 IN (0, 3)),
b AS (SELECT formula, arg_min(hit, (coalesce(e, 'inf'::DOUBLE), hit)) AS best, string_agg(hit, ',' ORDER BY coalesce(e, 'inf'::DOUBLE), hit) AS every FROM h GROUP BY 1)
SELECT id, CASE WHEN due THEN best ELSE 'old' END AS mp_id, CASE WHEN due THEN coalesce(every, '') ELSE 'old,older' END AS alternates, CASE WHEN due THEN '2024-02-20' ELSE strftime(stamp, '%Y-%m-%d') END AS synced FROM d LEFT JOIN b ON asks = b.formula""")
def stamped_materials(t, spark):
    """Summaries after a round of look-ups: those that were due are stamped, with a match or without."""
    n, size = F.col("p_partkey"), F.col("p_size")
    formula = F.when(n % 4 == 0, F.concat(F.lit("Nb"), n, F.lit("_Sn"))).when(n % 4 == 1, F.col("p_name")).when(n % 4 == 2, F.concat(F.lit("La"), size, F.lit(".5O"))).otherwise(F.concat(F.lit("V_"), n))
    at = F.when(size % 3 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01"), "yyyy-MM-dd") + size * 86_400))
    m = t("part").select(F.concat(F.lit("mat:"), n).alias("id"), formula.alias("formula"), F.lit("old").alias("mp_id"), F.array(F.lit("old"), F.lit("older")).alias("mp_alternate_ids"), at.alias("mp_synced_at"))
    k = F.col("l_partkey")
    hits = t("lineitem").select(
        F.when(k % 4 == 0, F.concat(F.lit("Nb"), k, F.lit("Sn"))).when(k % 4 == 3, F.concat(F.lit("V"), k)).alias("formula"), F.concat(F.lit("mp-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("material_id"),
        F.when(F.col("l_tax") > 0.03, F.col("l_tax")).alias("energy_above_hull"),
    ).where("formula is not null")
    now = F.lit("2024-02-20").cast("timestamp")
    hits = hits.join(enrichment.to_look_up(m, now), "formula", "left_semi")  # the service is asked for these only
    out = enrichment.looked_up(m, hits, now)
    return out.select("id", "mp_id", F.array_join("mp_alternate_ids", ",").alias("alternates"), F.date_format("mp_synced_at", "yyyy-MM-dd").alias("synced"))


# Formulas made of a part's numbers: a form by its key, a count by its size. What they come to by the rules is worked out by form in the SQL.
FORMS = (
    "'La0.' || s || 'Sr' || s || 'MnO3'", "'BaTiO3'", "'YBa2Cu3O6.' || s", "'Ga1.' || s || 'As'", "'Ga1' || s || 'As'", "'Ga' || s || 'As film'", "'LaH' || s",
    "'Co' || s || 'Sn'", "'Sr-Ru-O'", "'Fm-3m-CeH' || s", "'YBa2Cu3O7-'", "'Ba(x=0.' || s || ')'",
)
CHECKED_SQL = f"""
m AS (SELECT *, CASE p_partkey % 12 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(FORMS))} END AS formula FROM (
 SELECT p_partkey, (p_partkey % 12)::INTEGER AS form, p_size::VARCHAR AS s, p_size::DOUBLE AS tc, CASE WHEN p_size % 2 = 0 THEN 'nims:' ELSE 'mat:' END || p_partkey AS id, p_size % 5 = 0 AS named FROM part))"""


def checked(t):
    """Parts as summaries with such formulas; one in five has the family `chalcogenide`."""
    n, s, size = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_size")
    spell = lambda form: F.concat(*[s if x == "s" else F.lit(x.strip("'")) for x in form.split(" || ")])
    formula = F.element_at(F.array(*map(spell, FORMS)), (n % len(FORMS) + 1).cast("int"))
    return t("part").select(
        F.concat(F.when(size % 2 == 0, "nims:").otherwise("mat:"), n).alias("id"), formula.alias("formula"), size.cast("double").alias("tc_max"), F.when(size % 5 == 0, "chalcogenide").alias("family"), F.lit(1).alias("total_papers"),
        F.when(n % 7 == 0, "theoretical").otherwise("mixed").alias("dominant_evidence"), F.when(n % 2 == 0, size.cast("double")).alias("tc_max_experimental"), F.lit(False).alias("needs_review"),
        F.lit(None).cast("string").alias("review_reason"), F.lit(None).cast("string").alias("admin_decision"),
    )


@query(f"""WITH {CHECKED_SQL},
said AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS k, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1),
sig AS (SELECT DISTINCT regexp_replace(lower(formula), '[^a-z0-9]', '', 'g') AS z, formula FROM m WHERE form IN (3, 4)),
dup AS (SELECT z, count(*) AS n FROM sig GROUP BY 1 HAVING count(*) > 1),
near AS (SELECT sig.formula, 'near_dup(' || (SELECT string_agg(formula, ',' ORDER BY formula) FROM (SELECT o.formula FROM sig o WHERE o.z = sig.z AND o.formula <> sig.formula ORDER BY 1 LIMIT 3)) || ')' AS issue FROM sig JOIN dup USING (z)),
a AS (SELECT id, m.formula, tc, form,
 CASE form WHEN 0 THEN 'manganite_CMR_not_SC' WHEN 1 THEN 'substrate_or_ferroelectric' END AS other,
 CASE WHEN form IN (2, 10) THEN 'cuprate' WHEN form = 8 THEN 'ruthenate' WHEN form IN (6, 9) AND s::INTEGER >= 2 THEN 'hydride' WHEN form = 9 THEN 'heavy_fermion' WHEN form = 1 THEN 'conventional' END AS fresh,
 CASE WHEN k > coalesce(c, 0) THEN 'kagome' END AS vote, near.issue,
 CASE form WHEN 5 THEN 'descriptive_word' WHEN 8 THEN 'system_designator_not_compound' WHEN 9 THEN 'phase_prefix_in_formula' WHEN 10 THEN 'incomplete_or_charged_formula' WHEN 11 THEN 'condition_descriptor' END AS reason
 FROM m LEFT JOIN said ON l_partkey = p_partkey LEFT JOIN near ON near.formula = m.formula WHERE NOT named),
i AS (SELECT id, formula, other, 'misclassified_should_be_' || fresh AS wrong, CASE WHEN fresh IS NULL AND other IS NULL THEN 'NER_says_' || vote || '_verify' END AS verify,
 CASE WHEN fresh IS NULL AND other IS NULL AND tc > 40 THEN 'implausible_tc_' || printf('%.1f', tc) || 'K_on_null' END AS hot, issue, 'formula_reject_' || reason AS odd FROM a)
SELECT id, formula, concat_ws('|', other, wrong, verify, hot, issue, odd) AS issues, CASE WHEN other IS NOT NULL THEN 'CONTAMINANT' WHEN wrong IS NOT NULL THEN 'FAMILY_MISCLASS' WHEN verify IS NOT NULL THEN 'NER_VERIFY'
 WHEN hot IS NOT NULL THEN 'TC_IMPLAUSIBLE' WHEN issue IS NOT NULL THEN 'NEAR_DUP' WHEN odd IS NOT NULL THEN 'FORMULA_ODD' ELSE 'correctly_null' END AS tag FROM i""")
def null_family_audit(t, spark):
    """What speaks against having no family, for every part without one; lines say `kagome` or `conventional`."""
    said = t("lineitem").join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.when(F.col("p_size") % 2 == 0, "nims:").otherwise("mat:"), "l_partkey").alias("id"), F.when(F.col("l_returnflag") == "N", " Kagome").when(F.col("l_returnflag") == "R", " Conventional").otherwise("unknown").alias("family")
    )
    found = spotchecks.null_family(checked(t), said)
    return found.select("id", "formula", F.array_join("issues", "|").alias("issues"), "tag")


@query(f"""WITH {CHECKED_SQL},
r(rule_name, forms) AS (VALUES ('ner_extracted_descriptive_text', [5, 11]), ('system_designator_not_compound', [8]), ('phase_prefix_in_formula', [9]), ('incomplete_or_charged_formula', [10]))
SELECT rule_name, count(id) AS rows_flagged, min(id) AS first FROM r LEFT JOIN m ON list_contains(forms, form) GROUP BY 1""")
def naming_audit(t, spark):
    """The four rules on how formulas are written, one by one, as the reports table has them."""
    path = fresh_path(spark, "naming")
    audits.audit(checked(t), rules.naming(), path, "hour")
    return audits.tables(spark, path)[0].read().select("rule_name", "rows_flagged", F.try_element_at("sample_ids", F.lit(1)).alias("first"))


@query(f"""WITH {CHECKED_SQL},
f AS (SELECT id, form, tc, named, id[:4] AS prefix, p_partkey % 7 = 0 AND p_partkey % 2 <> 0 AS theory,
 CASE WHEN form IN (2, 10) THEN 'cuprate' WHEN form = 8 THEN 'ruthenate' WHEN form IN (6, 9) AND s::INTEGER >= 2 THEN 'hydride' WHEN form = 9 THEN 'heavy_fermion' WHEN form = 1 THEN 'conventional' END AS fresh,
 CASE form WHEN 0 THEN 'LaSrMnO' || s WHEN 2 THEN 'YBaCuO' || s WHEN 3 THEN 'Ga1.' || s WHEN 4 THEN 'Ga1' || s WHEN 5 THEN 'Ga' || s WHEN 6 THEN 'LaH' || s WHEN 7 THEN 'CoSn' || s WHEN 9 THEN 'CeH' || s ELSE form::VARCHAR END AS atoms FROM m),
d AS (SELECT *, count(*) OVER (PARTITION BY atoms) AS every, count(*) OVER (PARTITION BY atoms, prefix) AS same FROM f),
k AS (SELECT form = 5 AS "A", tc > 250 OR (named AND tc > 40) AS "B", fresh IS NOT NULL AND named AS "C", fresh IS NOT NULL AND NOT named AS miss, theory, same > 1 AS "D", every > 1 AND same = 1 AS xprov FROM d),
n AS (SELECT count(*) FILTER ("A") AS a, count(*) FILTER ("B") AS b, count(*) FILTER (theory AND NOT "B") AS soft, count(*) FILTER ("C") AS c, count(*) FILTER (miss) AS m, count(*) FILTER ("D") AS d, count(*) FILTER (xprov) AS x,
 count(*) FILTER ("A" OR "B" OR "C" OR "D") AS hard, count(*) AS rows FROM k),
u AS (SELECT unnest(['A', 'B', 'B-soft', 'C', 'C-miss', 'D', 'D-xprov', 'hard']) AS class, unnest([true, true, false, true, false, true, false, true]) AS hard, unnest([a, b, soft, c, m, d, x, hard]) AS n, rows FROM n)
SELECT class, hard, n, round(100.0 * n / rows, 2) AS pct FROM u""")
def spot_check_all(t, spark):
    """The spot check on every part instead of a sample, tallied."""
    return spotchecks.tally(spotchecks.spot_check(checked(t), None))
