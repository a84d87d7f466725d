"""Vector index, agreement with intervals, and discrete tails on whole test tables, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers
from lodestone.operators import agreement as A
from lodestone.operators import audits, rules, tails
from lodestone.operators import tables as T
from lodestone.operators.vector_index import VectorIndex, fresh_path

from .evidence_demo import with_records
from .registry import ORACLE_SQL, query


def _asked(e):
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("""
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM r WHERE rank <= 10""")
def vector_index_exact(t, spark):
    """Half of the labels are indexed, the others put into the same cells later; every cell is probed."""
    e = t("embeddings")
    index = VectorIndex.build(e.where("label < 5"), fresh_path(spark, "index"), leaf=100)
    index.insert(e.where("label >= 5 or label is null"))
    near = index.search(_asked(e), 10, 1.0)
    return near.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


@query("""
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label IN (1, 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def vector_index_filtered(t, spark):
    """Nearest among the vectors of two labels, the filter applied inside the index."""
    e = t("embeddings")
    index = VectorIndex.build(e, fresh_path(spark, "index"), keep=("label",), leaf=50)
    return index.search(_asked(e), 5, 1.0, where=F.col("label").isin(1, 4)).select("query_id", F.col("id").alias("vec_id"), "rank")


@query()
def vector_index_probed(t, spark):
    """Ten nearest from the share of small cells that a sample says finds 95 of 100; tests measure the recall."""
    e = t("embeddings")
    index = VectorIndex.build(e, fresh_path(spark, "index"), leaf=20)
    near = index.search(_asked(e), 10, index.calibrate(10, 0.95))
    return near.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


@query()
def alpha_with_interval(t, spark):
    """Agreement of the lines of an order on their return flag, with its interval."""
    return A.alpha_interval(t("lineitem"), "l_orderkey", "l_returnflag", replicates=500)


@query("""
WITH s AS (SELECT DISTINCT l_returnflag AS mode, l_suppkey AS paper, l_linenumber % 3 AS run, CASE WHEN l_quantity > 25 THEN l_linestatus || floor(l_quantity / 5)::INTEGER END AS item FROM lineitem),
w AS (SELECT mode, paper FROM s GROUP BY 1, 2 HAVING count(DISTINCT run) = 3),
k AS (SELECT mode, paper, item, count(*) AS k FROM s SEMI JOIN w USING (mode, paper) WHERE item IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT mode, count(*) AS items, 3 * count(*) AS n, sum(k) AS one, sum(2 * k * (3 - k) / 2.0) AS o FROM k GROUP BY 1),
p AS (SELECT mode, count(*) AS papers FROM w GROUP BY 1)
SELECT mode, papers, coalesce(items, 0) AS items, round(1 - (o / n) / ((n::DOUBLE * n - one::DOUBLE * one - (n - one)::DOUBLE * (n - one)) / (n::DOUBLE * (n - 1))), 6) AS alpha FROM p LEFT JOIN c USING (mode)""")
def intra_run_alpha(t, spark):
    """Agreement of the three runs of each model on the sets they found, over the papers that have all three."""
    runs = t("lineitem").select(
        F.col("l_returnflag").alias("mode"), F.col("l_suppkey").alias("paper"), (F.col("l_linenumber") % 3).alias("run"),
        F.when(F.col("l_quantity") > 25, F.concat("l_linestatus", F.floor(F.col("l_quantity") / 5).cast("int").cast("string"))).alias("item"),
    )
    return A.set_alpha(runs, "run", "paper", "item", 3, ["mode"])


@query("""
WITH v AS (SELECT count(*)::DOUBLE AS v FROM lineitem GROUP BY l_partkey), low AS (SELECT quantile_disc(v, 0.5) AS q FROM v),
s AS (SELECT count(*) AS n, sum(ln(v)) AS logs, any_value(q) AS q FROM v, low WHERE v >= q),
g AS (SELECT 1.5 + i / 200.0 AS a FROM range(0, 5600) r(i)),
z AS (SELECT a, q, n, logs, list_sum(list_transform(range(0, 12), lambda k: pow(q + k, -a))) + pow(q + 12, 1 - a) / (a - 1) + 0.5 * pow(q + 12, -a)
  + a * pow(q + 12, -a - 1) / 12 - a * (a + 1) * (a + 2) * pow(q + 12, -a - 3) / 720 + a * (a + 1) * (a + 2) * (a + 3) * (a + 4) * pow(q + 12, -a - 5) / 30240 AS z FROM g, s),
b AS (SELECT arg_max(a, -n * ln(z) - a * logs) AS a FROM z),
f AS (SELECT b.a + i / 200000.0 AS a FROM b, range(-1000, 1001) r(i)),
y AS (SELECT a, q, n, logs, list_sum(list_transform(range(0, 12), lambda k: pow(q + k, -a))) + pow(q + 12, 1 - a) / (a - 1) + 0.5 * pow(q + 12, -a)
  + a * pow(q + 12, -a - 1) / 12 - a * (a + 1) * (a + 2) * pow(q + 12, -a - 3) / 720 + a * (a + 1) * (a + 2) * (a + 3) * (a + 4) * pow(q + 12, -a - 5) / 30240 AS z FROM f, s)
SELECT any_value(q) AS x_min, any_value(n) AS tail, round(arg_max(a, -n * ln(z) - a * logs), 3) AS alpha FROM y""")
def discrete_exponent(t, spark):
    """The exponent of the discrete power law of the lines a part has, from their median on; the SQL searches two grids of exponents."""
    v = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("v"))
    low = v.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").cast("double").alias("q"))
    tail = v.join(low, F.col("v") >= F.col("q")).agg(F.first("q").alias("q"), F.count("*").alias("n"), F.sum(F.ln("v")).alias("logs"))

    def fit(parts):
        for s in parts:
            if len(s):
                yield s.assign(alpha=tails.exponents(s["n"].to_numpy(float), s["logs"].to_numpy(float), s["q"].to_numpy(float))[0])

    one = tail.mapInPandas(fit, "q double, n long, logs double, alpha double")
    return one.select(F.col("q").alias("x_min"), F.col("n").alias("tail"), F.round("alpha", 3).alias("alpha"))


@query()
def discrete_tail(t, spark):
    """The best discrete power law of the lines a part has, and what it is held against; tests hold both against slow fits."""
    v = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("v"))
    fit = tails.discrete_power_law(v, "v").first()
    told = [("alpha", fit.alpha, None), ("sigma", fit.sigma, None), ("low", fit.low, None), ("high", fit.high, None), ("x_min", fit.x_min, None), ("distance", fit.distance, None), ("tail", float(fit.tail), None)]
    one = spark.createDataFrame([(n, None if v is None else round(v, 6), p) for n, v, p in told], "metric string, value double, p double")
    if fit.alpha is None:
        return one
    ratios = tails.tail_ratios(v, "v", fit.x_min, fit.alpha)
    return one.unionByName(ratios.select(F.concat(F.lit("against_"), "alternative").alias("metric"), F.round("ratio", 4).alias("value"), F.round("p", 6).alias("p")))


RULES = (
    "tc_exceeds_family_cap", "tc_at_ambient_above_record", "implausible_pressure", "hydride_low_pressure_high_tc", "ambient_sc_with_high_pressure", "record_year_out_of_range",
    "arxiv_year_mismatch", "citation_conflation_review_paper", "tc_exceeds_compound_cap", "family_unconv_contradiction", "sole_source_retracted", "no_such_rule",
)


@query(f"""WITH a AS ({ORACLE_SQL["audit_rules"]}), v(rule_name) AS (VALUES {", ".join(f"('{r}')" for r in RULES)}),
hits AS (SELECT id, review_reason AS r FROM a WHERE needs_review UNION ALL SELECT id, unnest(string_split(counted, ',')) FROM a WHERE counted <> '')
SELECT rule_name, CASE WHEN rule_name = 'no_such_rule' THEN -1 ELSE count(id) END AS rows_flagged FROM v LEFT JOIN hits ON r = rule_name GROUP BY rule_name""")
def audit_reports(t, spark):
    """The eleven rules one by one, with a twelfth that fails, as the reports table has them."""
    p, m, flat = with_records(t, every=True)
    over = spark.createDataFrame([("fese", "tc_max", "37", True, "book")], "canonical string, field string, override_value string, is_cap boolean, source string")
    path = fresh_path(spark, "audit")
    audits.audit(m, [*rules.standard(p, over, 2024, flat), rules.Rule("no_such_rule", "critical", F.col("no_such_column") > 0)], path, "first")
    return audits.tables(spark, path)[0].read().select("rule_name", "rows_flagged")


@query("""
WITH a AS (SELECT p_brand, count(*)::DOUBLE AS n, sum(l_quantity)::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1996 GROUP BY 1),
b AS (SELECT p_brand, count(*)::DOUBLE AS n, sum(l_quantity)::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1997 GROUP BY 1),
m AS (SELECT 'n' AS metric, p_brand, a.n AS old, b.n AS new FROM a JOIN b USING (p_brand) UNION ALL SELECT 'q', p_brand, a.q, b.q FROM a JOIN b USING (p_brand)),
r AS (SELECT *, round(new - old, 6) AS delta, row_number() OVER (PARTITION BY metric ORDER BY abs(round(new - old, 6)) DESC, p_brand) AS rank FROM m WHERE round(new - old, 6) <> 0)
SELECT metric, rank::INTEGER AS rank, p_brand, old, new, delta, round(100 * delta / nullif(abs(old), 0), 2) AS percent FROM r WHERE rank <= 10""")
def snapshot_movers(t, spark):
    """The brands whose lines and quantities moved most between two years."""
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda y: j.where(F.year("l_shipdate") == y).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return T.movers(side(1996), side(1997), ["p_brand"], ["n", "q"])


_units = " ".join(f"WHEN '{u}' THEN {k}" for u, k in numbers.KELVIN.items())


@query(f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, CASE l_linenumber % 6 WHEN 0 THEN 'K' WHEN 1 THEN 'meV' WHEN 2 THEN 'cm^-1' WHEN 3 THEN 'THz' WHEN 4 THEN 'furlong' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, round(v * CASE coalesce(unit, 'K') {_units} END, 6) AS kelvin FROM l""")
def lines_in_kelvin(t, spark):
    """Quantities in units of energy, read as temperatures; a unit nobody knows has none, a missing one is Kelvin."""
    n = F.col("l_linenumber") % 6
    unit = F.when(n == 0, "K").when(n == 1, "meV").when(n == 2, "cm^-1").when(n == 3, "THz").when(n == 4, "furlong")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.to_kelvin(F.col("l_quantity"), unit), 6).alias("kelvin"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 - 20 AS tc, CASE WHEN l_tax > 0.02 THEN l_tax * 9000 END AS p, CASE WHEN l_discount > 0.03 THEN l_discount * 130 END AS lam,
 CASE WHEN l_linenumber > 2 THEN l_linenumber / 10.0 END AS mu, CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 10 END AS om, l_discount * 8 AS conf FROM lineitem)
SELECT l_orderkey, l_linenumber, tc BETWEEN 0.01 AND 400 AND (p IS NULL OR p BETWEEN 0 AND 500) AND (lam IS NULL OR lam BETWEEN 0.01 AND 10) AND (mu IS NULL OR mu BETWEEN 0 AND 0.5)
 AND (om IS NULL OR om BETWEEN 1 AND 5000) AND NOT (p IS NULL AND lam IS NULL AND mu IS NULL AND om IS NULL) AS fits,
 round(CASE WHEN (tc > 300 OR tc < 0.01) AND conf >= 0.3 THEN 0.3 ELSE conf END, 6) AS confidence FROM l""")
def hydride_gates(t, spark):
    """Ranges that hydride records have to keep, and confidence lowered where the temperature is implausible."""
    tc, p = F.col("l_quantity") * 10 - 20, F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 9000)
    lam, mu = F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 130), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") / 10.0)
    om = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / 10)
    fits = numbers.hydride_fit(tc, p, lam, mu, om)
    return t("lineitem").select("l_orderkey", "l_linenumber", fits.alias("fits"), F.round(numbers.capped_confidence(tc, F.col("l_discount") * 8), 6).alias("confidence"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, (100 + round(l_discount * 100)::INTEGER)::VARCHAR AS k, l_linenumber::VARCHAR AS n, l_suppkey % 4 AS a, l_partkey % 5 AS b, l_orderkey % 3 AS c FROM lineitem),
p AS (SELECT *, ['la', 'nd', 'ba', 'y'][a + 1] AS first, ['cu', 'fe', 'ni', 'bi', 'ru'][b + 1] AS metal FROM l)
SELECT l_orderkey, l_linenumber, first || k[1] || '.' || k[2:] || 'sr0.' || k[2:] || metal || n || CASE c WHEN 0 THEN 'o4' WHEN 1 THEN 'as2' ELSE '(o2f)2' END AS key,
 array_to_string(list_transform([first, 'sr', metal, CASE c WHEN 1 THEN 'as' ELSE 'o' END], lambda x: upper(x[1]) || x[2:]), ',') || CASE c WHEN 2 THEN ',F' ELSE '' END AS elements FROM p""")
def written_formulas(t, spark):
    """Formulas made of a line's numbers in several spellings (brackets, subscripts, spaces, surplus): their keys and elements."""
    k = (F.lit(100) + F.round(F.col("l_discount") * 100).cast("int")).cast("string")
    first = F.element_at(F.array(*map(F.lit, ("La", "Nd", "Ba", "Y"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    metal = F.element_at(F.array(*map(F.lit, ("Cu", "Fe", "Ni", "Bi", "Ru"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, ("(O)_{4}", "[As2]", "(O2F)_2"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    end = F.when((F.col("l_orderkey") % 3 == 0), F.lit("[O_{4}]")).otherwise(end)
    more = F.element_at(F.array(*map(F.lit, ("", "-δ", " + delta", "$", " "))), (F.col("l_partkey") % 5 + 1).cast("int"))
    left, right = F.substring(k, 1, 1), F.substring(k, 2, 2)
    raw = F.concat(first, F.lit("_{"), left, F.lit("."), right, F.lit("} (Sr₀."), right, F.lit(")"), metal, F.lit("$_"), F.col("l_linenumber").cast("string"), F.lit("$ "), end, more)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    told = formulas.described(rows, "raw", key=formulas.canonical, elements=lambda c: F.array_join(formulas.elements(c), ","))
    return told.select("l_orderkey", "l_linenumber", "key", "elements")
