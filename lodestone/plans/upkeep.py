"""Listings, upkeep, imports, agreement and streaming twins on whole test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import agreement as A
from lodestone.operators import harvest as H
from lodestone.operators import statistics, summary, timeline, vectors
from lodestone.operators import tables as T
from lodestone.streaming import jobs

from .evidence_demo import FORMULAS, RECORDS_SQL, with_records
from .registry import query

big = lambda c: c.cast("long")
FIRSTS = "firsts AS (SELECT key, min(formula) AS f FROM kept GROUP BY 1)"


@query(f"""WITH {RECORDS_SQL}, {FIRSTS},
m AS (SELECT k.key, any_value(forms.family) AS family, max(tc) AS tc_max, count(DISTINCT paper_id) AS papers, min(tier) AS best, count(*) FILTER (source = 'aps') > 0 AS aps
 FROM kept k JOIN firsts USING (key) JOIN forms ON forms.formula = firsts.f GROUP BY 1),
f AS (SELECT * FROM m WHERE family IN ('cuprate', 'iron_based', 'hydride', 'conventional') AND tc_max >= 20 AND papers >= 2 AND aps AND best <= 'T2')
SELECT 'mat:' || key AS id, family, tc_max, papers AS total_papers, best AS best_credibility_tier, (SELECT count(*) FROM f) AS total FROM f ORDER BY tc_max DESC, id LIMIT 10 OFFSET 2""")
def material_listing(t, spark):
    """One page of summaries by family, value, support, source and tier, under the default gates, with the total."""
    _, m, flat = with_records(t)
    best = flat.groupBy("id").agg(F.min("tier").alias("best_credibility_tier"))
    m = m.join(best, "id").withColumn("parent_id", F.lit(None).cast("string"))
    page = timeline.listing(m, " cuprate,iron_based , hydride,conventional", tc_min=20.0, min_papers=2, aps=True, max_tier="T2", parents=True, offset=2, limit=10, records=flat)
    return page.select("id", "family", "tc_max", "total_papers", "best_credibility_tier", "total")


@query(f"""WITH {RECORDS_SQL} SELECT paper_id, pressure AS pressure_gpa, tc AS tc_kelvin, year::INTEGER AS year FROM kept WHERE key = 'mgb2'""")
def phase_records(t, spark):
    """The phase table of one material: its records by pressure, value and year."""
    _, m, flat = with_records(t)
    return timeline.phase_table(m, "mat:mgb2", flat).select("paper_id", "pressure_gpa", "tc_kelvin", "year")


@query(f"""WITH {RECORDS_SQL}, {FIRSTS}, p AS (SELECT DISTINCT key, year, round_even(tc, 1) AS tc, round_even(pressure, 0) AS pressure, measurement = 'dft' AS theory FROM kept WHERE tc > 0 AND tc <= 300)
SELECT count(*) AS total_points, count(DISTINCT key) AS total_materials, min(year)::INTEGER AS year_min, max(year)::INTEGER AS year_max FROM p""")
def timeline_coverage(t, spark):
    p, m, flat = with_records(t)
    return timeline.coverage(timeline.points(m, p, 2024, records=flat))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS c, min(l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS id, CASE WHEN coalesce(o_orderstatus, '') <> 'F' THEN o_orderstatus ELSE coalesce('10.1/' || p, NULL) END AS doi,
 CASE WHEN c > 4 THEN c ELSE o_custkey END AS citation_count, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority ELSE 'J' || c END AS journal,
 CASE WHEN c IS NULL THEN 'old' WHEN c % 2 = 0 THEN 'review' WHEN c % 3 = 0 THEN 'computational' ELSE 'old' END AS paper_type
FROM orders LEFT JOIN n ON o_orderkey = l_orderkey""")
def enrich_papers(t, spark):
    """News of a catalogue on papers: empty fields are filled, counts and types replaced; the others stay."""
    s = lambda x: F.lit(x)
    p = t("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("doi"), big(F.col("o_custkey")).alias("citation_count"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("journal"), s("old").alias("paper_type"),
    )
    n = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.count("*").alias("c"), F.min("l_partkey").alias("p"))
    kinds = F.when(F.col("c") % 2 == 0, F.array(s("Study"), s("Review"))).when(F.col("c") % 3 == 0, F.array(s("?"), s("Dataset"))).otherwise(F.array(s("?")))
    news = n.select("id", F.concat(s("10.1/"), "p").alias("doi"), F.when(F.col("c") > 4, F.col("c")).otherwise(0).alias("citation_count"), F.concat(s("J"), "c").alias("journal"), kinds.alias("types"))
    return H.enrich(p, news)


@query("""
WITH r AS (SELECT DISTINCT l_suppkey AS item, l_returnflag || l_linestatus AS rater FROM lineitem)
SELECT i.item, a.rater, (EXISTS (SELECT 1 FROM r WHERE r.item = i.item AND r.rater = a.rater))::INTEGER AS said FROM (SELECT DISTINCT item FROM r) i, (SELECT DISTINCT rater FROM r) a""")
def dense_ratings(t, spark):
    """1 or 0 for every item and every rater."""
    r = t("lineitem").select(F.col("l_suppkey").alias("item"), F.concat("l_returnflag", "l_linestatus").alias("rater"))
    return H.completed(r, r, "item", "rater")


@query("""
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def bookmark_page(t, spark):
    """The second page of what a group has marked, with what it points at, latest first."""
    c = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    j = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return T.page(j, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20, 20).select("o_orderkey", "c_name", "o_totalprice")


@query(f"""WITH {RECORDS_SQL.split(', every AS')[0].split(',' + chr(10) + 'every AS')[0]},
r AS (SELECT formula, key, l_quantity::DOUBLE AS tc, CASE WHEN l_tax > 0.05 THEN l_linenumber::DOUBLE WHEN l_tax > 0.02 THEN 0.0 END AS pressure, CASE WHEN l_suppkey % 3 > 0 THEN 's' || l_suppkey % 3 END AS structure,
 'r' || l_orderkey % 97 AS reference FROM lineitem JOIN forms ON l_partkey % {len(FORMULAS)} = i),
s AS (SELECT *, nullif(concat_ws(', ', CASE WHEN pressure <> 0 THEN 'P=' || pressure || ' GPa' END, structure), '') AS said FROM r)
SELECT 'nims:' || key AS id, min(formula) AS formula, max(tc) AS tc_max, max(tc) FILTER (coalesce(pressure, 0) = 0) AS tc_ambient, max(tc) FILTER (coalesce(pressure, 0) = 0) IS NOT NULL AS ambient_sc,
 CASE WHEN count(*) FILTER (structure = 's1') >= count(*) FILTER (structure = 's2') THEN 's1' ELSE 's2' END AS crystal_structure, CASE WHEN max(pressure) > 0 THEN 'hydrostatic' END AS pressure_type,
 count(DISTINCT reference) AS total_papers, count(*) AS records FROM s GROUP BY key""")
def table_import(t, spark):
    """Rows of an outside table, numbers as text, to one summary a formula."""
    names = F.array(*map(F.lit, FORMULAS))
    r = t("lineitem").select(
        F.element_at(names, (F.col("l_partkey") % len(FORMULAS) + 1).cast("int")).alias("formula"), F.concat("l_quantity", F.lit(" K")).alias("tc"),
        F.when(F.col("l_tax") > 0.05, F.concat("l_linenumber", F.lit(" GPa"))).when(F.col("l_tax") > 0.02, "0").alias("pressure"),
        F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("s"), F.col("l_suppkey") % 3)).otherwise(" ").alias("structure"), F.concat(F.lit("r"), F.col("l_orderkey") % 97).alias("reference"),
    )
    return H.import_rows(r).select("id", "formula", "tc_max", "tc_ambient", "ambient_sc", "crystal_structure", "pressure_type", "total_papers", "records")


@query("""
SELECT 'papers' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'retracted', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'materials', count(*) FROM part
UNION ALL SELECT 'pending', count(*) FROM part WHERE p_size > 40 UNION ALL SELECT 'families', count(DISTINCT p_type) FROM part UNION ALL SELECT 'highest_tc', max(p_retailprice) FROM part UNION ALL SELECT 'chunks', count(*) FROM documents""")
def dashboard_counts(t, spark):
    """The numbers of the landing page."""
    papers = t("orders").select(F.when(F.col("o_orderstatus") == "P", "retracted").alias("status"))
    return H.dashboard(papers, t("part").select((F.col("p_size") > 40).alias("needs_review"), F.col("p_type").alias("family"), F.col("p_retailprice").alias("tc_max")), t("documents").select("doc_id"))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY coalesce(CASE WHEN l_tax > 0.01 THEN l_discount END, -1) DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def most_confident(t, spark):
    """The record of most confidence of each key, no confidence counting as -1."""
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("c"))
    return T.keep_best(rows, ["l_partkey"], "c", F.col("l_orderkey"), F.col("l_linenumber")).drop("c")


@query("""
WITH h AS (SELECT l_partkey, l_orderkey || '-' || l_linenumber AS m, CASE WHEN l_tax > 0.03 THEN l_tax END AS e FROM lineitem)
SELECT l_partkey, arg_min(m, (coalesce(e, 'inf'::DOUBLE), m)) AS primary_, string_agg(m, ',' ORDER BY coalesce(e, 'inf'::DOUBLE), m) AS alternates FROM h GROUP BY 1""")
def hull_matches(t, spark):
    """Hits of each key by energy above hull, missing ones last; the first is the match."""
    h = t("lineitem").select("l_partkey", F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("material_id"), F.when(F.col("l_tax") > 0.03, F.col("l_tax")).alias("energy_above_hull"))
    return H.best_match(h, "l_partkey").select("l_partkey", F.col("primary").alias("primary_"), F.array_join("alternates", ",").alias("alternates"))


@query("""
WITH r AS (SELECT l_partkey, l_suppkey, round(l_quantity, 0)::BIGINT AS q, min(l_orderkey) AS first FROM lineitem GROUP BY ALL)
SELECT l_partkey, count(*) AS records, string_agg(l_suppkey || ':' || q, ',' ORDER BY l_suppkey, q) AS said FROM r GROUP BY 1""")
def pooled_records(t, spark):
    """Nested records of all rows of a key, each identity once."""
    nested = t("lineitem").groupBy("l_partkey", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity"))).alias("records"))
    pooled = T.merge_records(nested.withColumnRenamed("l_orderkey", "ord"), "l_partkey", "records", lambda r: [r["l_suppkey"].alias("s"), F.round(r["l_quantity"], 0).alias("q")])
    said = F.array_sort(F.transform("records", lambda r: F.struct(r["l_suppkey"].alias("s"), big(F.round(r["l_quantity"], 0)).alias("q"))))
    return pooled.select("l_partkey", big(F.size("records")).alias("records"), F.array_join(F.transform(said, lambda r: F.concat(r["s"], F.lit(":"), r["q"])), ",").alias("said"))


@query("""
SELECT l_orderkey, string_agg(CASE WHEN l_tax > 0.05 THEN '' ELSE l_returnflag END || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_returnflag, l_tax) AS rewritten,
 coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (NOT (l_returnflag = 'R' AND l_tax > 0.02)), '') AS kept FROM lineitem GROUP BY 1""")
def repaired_records(t, spark):
    """Nested records rewritten and filtered in place, order kept."""
    nested = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_tax"))).alias("r"))
    new = T.rewrite_records(F.col("r"), l_returnflag=lambda r: F.when(r["l_tax"] > 0.05, "").otherwise(r["l_returnflag"]))
    kept = T.keep_records(F.col("r"), lambda r: ~((r["l_returnflag"] == "R") & (r["l_tax"] > 0.02)))
    return nested.select(
        "l_orderkey", F.array_join(F.transform(new, lambda r: F.concat(r["l_returnflag"], F.lit(":"), r["l_linenumber"])), ",").alias("rewritten"),
        F.array_join(F.transform(kept, lambda r: r["l_linenumber"].cast("string")), ",").alias("kept"),
    )


RUNS = "r AS (SELECT l_returnflag AS model, l_partkey AS paper, l_linenumber % 3 AS run, list_sort(list(DISTINCT l_suppkey % 4)) AS s FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""WITH {RUNS},
p AS (SELECT model, paper, count(*) AS runs, count(DISTINCT s) AS kinds FROM r GROUP BY 1, 2),
x AS (SELECT a.model, a.s = b.s AS same, abs(len(a.s) - len(b.s)) AS d FROM r a JOIN r b ON a.model = b.model AND a.paper = b.paper AND a.run < b.run),
y AS (SELECT model, count(*) AS pairs, count(*) FILTER (same) AS identical, count(*) FILTER (d > 0) AS count_diff, coalesce(median(d) FILTER (d > 0), 0) AS median_dn FROM x GROUP BY 1)
SELECT model, any_value(pairs) AS pairs, any_value(identical) AS identical, any_value(count_diff) AS count_diff, any_value(median_dn) AS median_dn, count(*) AS papers, count(*) FILTER (kinds = 1) AS stable,
 count(*) FILTER (kinds = runs AND runs > 1) AS "distinct", round(avg(kinds), 6) AS mean_outputs FROM p JOIN y USING (model) GROUP BY 1""")
def run_stability(t, spark):
    """How repeated runs of each model agree with themselves."""
    rows = t("lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("paper"), (F.col("l_linenumber") % 3).alias("run"), (F.col("l_suppkey") % 4).alias("item"))
    return A.run_stability(rows, "model", "paper", "run", "item")


@query("""
WITH a AS (SELECT l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT count(*) AS compared, count(*) FILTER (abs(a.v - b.v) <= 2) AS close, round(count(*) FILTER (abs(a.v - b.v) <= 2) / count(*), 6) AS rate FROM a JOIN b USING (l_partkey)""")
def value_agreement(t, spark):
    """How often two sets give values that differ by 2 at most."""
    li = t("lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return A.value_agreement(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["l_partkey"], "l_quantity")


@query("""
WITH a AS (SELECT l_suppkey, max(l_quantity)::DOUBLE AS q, min(l_returnflag) AS f FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
b AS (SELECT l_suppkey, max(l_quantity)::DOUBLE AS q, min(l_returnflag) AS f FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), x AS (SELECT a.q AS aq, b.q AS bq, a.f AS af, b.f AS bf, a.l_suppkey AS ak, b.l_suppkey AS bk FROM a FULL JOIN b USING (l_suppkey))
SELECT unnest(['fresh_rows', 'old_rows', 'in_both', 'orphans', 'fresh_only', 'match_q', 'match_f']) AS metric, unnest([count(ak), count(bk), count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL), count(*) FILTER (ak IS NULL), count(*) FILTER (bk IS NULL),
 count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND abs(aq - bq) <= 0.05), count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND af = bf)])::DOUBLE AS value FROM x""")
def aggregator_fidelity(t, spark):
    """Two runs of an aggregation side by side: rows, orphans, matches by field."""
    run = lambda s: t("lineitem").where(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.max("l_quantity").cast("double").alias("q"), F.min("l_returnflag").alias("f"))
    return T.fidelity(run("F"), run("O"), "l_suppkey", ["q", "f"])


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts::TIMESTAMP) / 1e6 AS came, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, round(max(came - 3600 * k) OVER (PARTITION BY user_id ORDER BY k) + 3600 * k, 3) AS release FROM e""")
def leaky_bucket(t, spark):
    """When a bucket that passes one event an hour and user lets each event go."""
    return jobs.throttled(t("events"), "user_id", "ts", 3600.0, ["event_id"]).select("event_id", F.round("release", 3).alias("release"))


@query("""
WITH last AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM last WHERE s IN ('F', 'O'))""")
def pending_work(t, spark):
    """What a run has to do: keys whose last status is neither done nor final."""
    status = F.when(F.col("o_orderstatus") == "F", "ok_full").when(F.col("o_orderstatus") == "O", "unsupported_no_text").otherwise("started")
    history = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", status.alias("status"))
    return jobs.pending(t("customer").select("c_custkey"), history, "c_custkey", ["o_orderdate", "o_orderkey"])


@query("""
WITH n AS (SELECT max(ts::TIMESTAMP) AS now FROM events) SELECT event_id FROM events, n WHERE ts::TIMESTAMP >= date_trunc('day', now - INTERVAL 2 DAY) AND ts::TIMESTAMP <= now""")
def incremental_take(t, spark):
    """What an incremental run takes without a cursor: the last two days."""
    e = jobs.stamped(t("events"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return jobs.since_cursor(e, F.lit(None).cast("timestamp"), now).select("event_id")


@query("""
WITH n AS (SELECT max(ts::TIMESTAMP) AS now FROM events) SELECT event_id FROM events, n WHERE epoch_us(now) - epoch_us(ts::TIMESTAMP) > 1800 * 1000000""")
def expired_folders(t, spark):
    """What has not been touched for half an hour."""
    e = jobs.stamped(t("events"))
    return jobs.expired(e, F.lit(e.agg(F.max("ts")).first()[0]), "ts").select("event_id")


@query("""
WITH p AS (SELECT doc_id AS id, source, lower(text) AS t FROM documents), k AS (SELECT *, nullif(regexp_replace(t, '[^\\p{L}\\p{N}]+', '', 'g'), '') AS work FROM p),
b AS (SELECT work, min(id) AS best FROM k WHERE source <> 'src0' AND work IS NOT NULL GROUP BY 1) SELECT id, CASE WHEN best <> id THEN best END AS related_id FROM k LEFT JOIN b USING (work)""")
def same_works(t, spark):
    """Documents of one title, linked to the published one."""
    d = t("documents").select(F.col("doc_id").alias("id"), "source", F.lit(None).cast("string").alias("doi"), F.col("text").alias("title"))
    return H.same_work(d, "src0").select("id", "related_id")


@query("""
SELECT c_custkey, list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296, 2166136261::HUGEINT)::DOUBLE / 4294967296 - 0.5 AS jitter FROM customer""")
def chart_jitter(t, spark):
    return t("customer").select("c_custkey", text.jitter(F.col("c_name")).alias("jitter"))


@query("""
WITH n AS (SELECT count(*) FILTER (v >= 30 AND v < 40) AS l, count(*) FILTER (v >= 45 AND v < 51) AS m, count(*) FILTER (v >= 51 AND v < 60) AS r FROM (SELECT l_extendedprice / 1000 AS v FROM lineitem)),
e AS (SELECT *, sqrt(l / 10 * r / 9) * 6 AS x FROM n), p AS (SELECT *, list_sum(list_transform(range(0, m + 1), lambda i: exp(i * ln(x) - x - lgamma(i + 1)))) AS tail FROM e)
SELECT unnest(['n_left', 'n_valley', 'n_right', 'density_left', 'density_valley', 'density_right', 'expected', 'p_raw', 'p_bonferroni']) AS metric,
 unnest([l, m, r, round(l / 10, 6), round(m / 6, 6), round(r / 9, 6), round(x, 6), round(tail, 6), round(least(1, tail * 8), 6)]) AS value FROM p""")
def valley_significance(t, spark):
    """A gap between two peaks: counts, densities, what was expected, Poisson tail, Bonferroni."""
    v = t("lineitem").select((F.col("l_extendedprice") / 1000).alias("v"))
    got = statistics.valley_test(v, "v", (30, 40), (45, 51), (51, 60))
    return got.where(~F.col("metric").rlike("^depth")).select("metric", F.when(F.col("metric").startswith("p_"), F.round("value", 6)).otherwise(F.col("value")).alias("value"))


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q WHERE vec_id <> 7),
b AS (SELECT label, arg_min(vec_id, (d, vec_id)) AS vec_id, min(d) AS d FROM d GROUP BY 1) SELECT label, vec_id, round(d, 6) AS distance FROM b ORDER BY b.d, vec_id LIMIT 3""")
def one_hit_a_document(t, spark):
    """The best hit of each document, the best three of those."""
    e = t("embeddings")
    every = e.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.one_hit_a_document(every, e, "label", 3).select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 15)
SELECT vec_id, label FROM d ORDER BY label DESC, d LIMIT 5""")
def reordered_hits(t, spark):
    """A short list of hits in the order of another column."""
    e = t("embeddings")
    hits = vectors.knn(e, list(e.where("vec_id = 7").first()["embedding"]), 15).join(e.select("vec_id", "label"), "vec_id")
    return T.reordered(hits, "label", 0, "distance").select("vec_id", "label").limit(5)


@query("""
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity >= 45) AND bool_or(CASE WHEN l_tax > 0.04 THEN l_discount END <= 0.01 OR l_tax <= 0.04)""")
def hit_filters(t, spark):
    """Search filters on nested records: a value reached, and a pressure at most so much, where a missing one passes."""
    one = F.struct(F.col("l_quantity").alias("tc_kelvin"), F.when(F.col("l_tax") > 0.04, F.col("l_discount")).alias("pressure_gpa"))
    nested = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("mats"))
    return nested.where(vectors.passes(F.col("mats"), 45.0, 0.01)).select("l_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey::BIGINT AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 0, o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def replaced_children(t, spark):
    """The children of some parents replaced as a whole."""
    kids = t("lineitem").select("l_orderkey", "l_linenumber", big(F.col("l_partkey")).alias("v"))
    zero = F.lit(0).cast(kids.schema["l_linenumber"].dataType)
    return T.replace_children(kids, t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), zero.alias("l_linenumber"), big(F.col("o_custkey")).alias("v")), "l_orderkey")


@query("""
WITH n AS (SELECT max(o_orderdate::TIMESTAMP) AS now FROM orders) SELECT o_orderkey FROM orders, n WHERE o_orderstatus = 'P' OR o_orderdate::TIMESTAMP < now - INTERVAL 90 DAY""")
def stale_papers(t, spark):
    """Never synchronised, or longer ago than ninety days."""
    o = t("orders").withColumn("at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")))
    now = F.lit(t("orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    return o.where(H.stale(F.col("at"), 90, now)).select("o_orderkey")


@query(f"""WITH {RECORDS_SQL.split(',' + chr(10) + 'every AS')[0]},
r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'mat:' || key WHEN p_size % 3 = 0 THEN 'nims:' || p_partkey ELSE 'mat:' || p_partkey END AS id, formula, key FROM part JOIN forms ON p_partkey % {len(FORMULAS)} = i),
n AS (SELECT DISTINCT id, formula, CASE WHEN id LIKE 'nims:%' THEN 'nims:' ELSE 'mat:' END || key AS new_id FROM r)
SELECT new_id, count(*) AS olds, CASE WHEN count(*) > 1 THEN 'merge' WHEN min(id) <> new_id THEN 'rekey' ELSE 'unchanged' END AS plan FROM n GROUP BY 1""")
def consolidation_plan(t, spark):
    """Rows under their present key: unchanged, re-keyed or merged."""
    from lodestone.functions import formulas

    f = F.element_at(F.array(*map(F.lit, FORMULAS)), (F.col("p_partkey") % len(FORMULAS) + 1).cast("int"))
    own = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("mat:"), formulas.canonical(f))).when(F.col("p_size") % 3 == 0, F.concat(F.lit("nims:"), "p_partkey")).otherwise(F.concat(F.lit("mat:"), "p_partkey"))
    return H.consolidate(t("part").select(own.alias("id"), f.alias("formula")).distinct()).select("new_id", big(F.size("old_ids")).alias("olds"), "plan")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, b.vec_id, list_cosine_distance(e::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM q JOIN embeddings b ON b.vec_id <> query_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM d),
l AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM h WHERE r <= 10 AND vec_id % 4 <> 1)
SELECT query_id, vec_id, n::INTEGER AS n, '[' || n || '] T' || vec_id || ' — Au et al. (n.d.) · s' AS block FROM l WHERE n <= 4""")
def retrieved_sources(t, spark):
    """Hits with their chunk and paper: retracted papers left out, the others numbered and quoted."""
    e = t("embeddings")
    hits = vectors.batch_knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10).drop("rank")
    ids = e.select("vec_id")
    chunks = ids.select("vec_id", F.col("vec_id").cast("string").alias("paper_id"), F.lit("s").alias("section"), F.lit("x").alias("text"))
    names = F.array(F.lit("Au, A"), F.lit("Bo"), F.lit("Cy"))
    papers = ids.select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 4 == 1, "retracted").alias("status"), F.concat(F.lit("T"), "vec_id").alias("title"), names.alias("authors"), F.lit(None).cast("int").alias("year"))
    return H.retrieve(hits, chunks, papers, 4).select("query_id", "vec_id", "n", "block")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 4 WHEN 0 THEN 'PRB' WHEN 1 THEN 'PRPER' WHEN 2 THEN NULL ELSE 'PRL' END AS abbrev, '10.1103/PhysRev' || CASE WHEN l_partkey % 5 = 0 THEN 'Focus.' WHEN l_partkey % 5 = 1 THEN '.' ELSE 'B.' END || l_orderkey || '.' || l_linenumber AS doi,
 CASE WHEN l_tax > 0.01 THEN ' 7' ELSE ' ' END AS volume, CASE WHEN l_tax > 0.02 THEN '2' END AS issue, CASE WHEN l_returnflag = 'A' THEN 'a1' END AS article, CASE WHEN l_returnflag = 'R' THEN '9' END AS page, year(l_shipdate) + 3 AS year FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abbrev IN (EXCLUDED) THEN 'excluded_journal:' || abbrev WHEN lower(doi) LIKE '10.1103/physrevfocus.%' THEN 'excluded_doi_prefix:10.1103/PhysRevFocus.' WHEN trim(volume) = '' THEN 'missing_volume' WHEN issue IS NULL THEN 'missing_issue'
 WHEN article IS NULL AND page IS NULL AND NOT (year <= YEAR AND regexp_matches(doi, 'LEGACY')) THEN 'missing_locator' END AS reason FROM i""".replace("EXCLUDED", ", ".join(f"'{x}'" for x in sorted(H.EXCLUDED_JOURNALS)) or "NULL").replace("YEAR AND", f"{H.LEGACY_YEAR} AND").replace("LEGACY", H.LEGACY_DOI))
def harvest_rejects(t, spark):
    """Why items are not harvested, the first reason in order."""
    c, s = F.col, F.lit
    kind = F.when(c("l_partkey") % 5 == 0, "Focus.").when(c("l_partkey") % 5 == 1, ".").otherwise("B.")
    items = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(c("l_suppkey") % 4 == 0, "PRB").when(c("l_suppkey") % 4 == 1, "PRPER").when(c("l_suppkey") % 4 == 3, "PRL").alias("abbrev"),
        F.concat(s("10.1103/PhysRev"), kind, "l_orderkey", s("."), "l_linenumber").alias("doi"), F.when(c("l_tax") > 0.01, " 7").otherwise(" ").alias("volume"), F.when(c("l_tax") > 0.02, "2").alias("issue"),
        F.when(c("l_returnflag") == "A", "a1").alias("article_number"), F.when(c("l_returnflag") == "R", "9").alias("page"), (F.year("l_shipdate") + 3).alias("year"),
    )
    return items.select("l_orderkey", "l_linenumber", H.reject_reason().alias("reason"))


@query("""
WITH s AS (SELECT p_type AS key, max(p_retailprice) AS tc, min(p_brand) AS phase FROM part GROUP BY 1), n AS (SELECT key, tc, phase, length(key) AS n FROM s)
SELECT key, CASE WHEN n % 3 = 0 THEN least(tc, 1500) WHEN n % 3 = 1 THEN 7 ELSE tc END AS tc_max, CASE WHEN n % 2 = 0 THEN 'fixed' ELSE phase END AS structure_phase FROM n""")
def curated_overrides(t, spark):
    """Exact values replace fields, caps only lower them."""
    s = t("part").groupBy(F.col("p_type").alias("key")).agg(F.max("p_retailprice").cast("double").alias("tc_max"), F.min("p_brand").alias("structure_phase"))
    book = F.col("key").alias("canonical"), F.lit("book").alias("source")
    n = F.char_length("key")
    over = s.where(n % 3 < 2).select(*book, F.lit("tc_max").alias("field"), F.when(n % 3 == 0, "1500").otherwise("7").alias("override_value"), (n % 3 == 0).alias("is_cap"))
    over = over.unionByName(s.where(n % 2 == 0).select(*book, F.lit("structure_phase").alias("field"), F.lit("fixed").alias("override_value"), F.lit(False).alias("is_cap")))
    return summary.apply_overrides(s.withColumn("review_reason", F.lit(None).cast("string")), over).select("key", "tc_max", "structure_phase")
