"""Corpus reports on the test tables, each with the SQL that must give the same rows.

Line items stand for evidence records: paper l_orderkey, material l_suppkey or l_partkey, family p_type, value l_extendedprice or
l_quantity, pressure l_tax, year of l_shipdate, retracted orders o_orderstatus = 'P', country n_name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import tables as T
from lodestone.operators.statistics import histogram, valleys

from .registry import query



def year():
    return F.year("l_shipdate")


def bucket():
    """The five years that l_shipdate falls in, by whole division."""
    return F.expr("year(l_shipdate) div 5 * 5").cast("long")


def big(c):
    return c.cast("long")


@query("""
WITH c AS (SELECT year(l_shipdate) // 5 * 5 AS bucket, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, p_type) AS rank FROM c)
SELECT bucket::BIGINT AS bucket, p_type, n, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def bucket_top3(t, spark):
    """The three largest groups of each five-year bucket."""
    n = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(bucket().alias("bucket"), "p_type").agg(F.count("*").alias("n"))
    return T.top_k(n, ["bucket"], [F.col("n").desc(), F.col("p_type")], 3)


@query("""
SELECT unnest(['records', 'papers', 'materials', 'max_value', 'first_year', 'returned_share']) AS metric,
 unnest([count(*)::DOUBLE, count(DISTINCT l_orderkey)::DOUBLE, count(DISTINCT l_suppkey)::DOUBLE, max(l_extendedprice), min(year(l_shipdate))::DOUBLE,
 round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 2)::DOUBLE]) AS value FROM lineitem""")
def headline_metrics(t, spark):
    """All headline numbers in one pass, stacked."""
    returned = F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 2)
    return T.stack_metrics(t("lineitem"), {
        "records": F.count("*"), "papers": F.count_distinct("l_orderkey"), "materials": F.count_distinct("l_suppkey"), "max_value": F.max("l_extendedprice"),
        "first_year": F.min(year()), "returned_share": returned,
    })


@query("""
SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM lineitem GROUP BY 1""")
def category_share(t, spark):
    return T.share(t("lineitem"), ["l_returnflag"]).withColumn("pct", F.col("pct").cast("double"))


@query("""
SELECT year(l_shipdate) AS year, p_type, count(*) AS records, count(DISTINCT l_orderkey) AS papers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def year_family_counts(t, spark):
    li = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(big(year()).alias("year"), "p_type").agg(F.count("*").alias("records"), F.count_distinct("l_orderkey").alias("papers"))


@query("""
SELECT year(coalesce(o_orderdate, TIMESTAMP '1990-01-01')) AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def papers_per_year(t, spark):
    day = F.coalesce("o_orderdate", F.lit("1990-01-01").cast("timestamp_ntz"))
    return t("orders").where("o_orderstatus <> 'P'").groupBy(big(F.year(day)).alias("year")).agg(F.count("*").alias("n"))


@query("""
SELECT year(l_shipdate) // 5 * 5 AS bucket, count(*) FILTER (l_tax > 0.04) AS high, count(*) FILTER (l_tax <= 0.04 OR l_tax IS NULL) AS low,
 round(avg(l_quantity) FILTER (l_tax > 0.04), 1) AS avg_high, round(avg(l_quantity) FILTER (l_tax <= 0.04 OR l_tax IS NULL), 1) AS avg_low FROM lineitem GROUP BY 1""")
def cond_split_by_bucket(t, spark):
    """Counts and means of two classes side by side; no pressure counts as low."""
    high = F.col("l_tax") > 0.04
    q, low = F.col("l_quantity"), ~F.coalesce(high, F.lit(False))
    return t("lineitem").groupBy(bucket().alias("bucket")).agg(
        F.count_if(high).alias("high"), F.count_if(low).alias("low"), F.round(F.avg(F.when(high, q)), 1).alias("avg_high"), F.round(F.avg(F.when(low, q)), 1).alias("avg_low")
    )


@query("""
WITH s AS (SELECT count(*) AS a, count(*) FILTER (l_quantity <= 25) AS a1, count(*) FILTER (l_returnflag <> 'N') AS b, count(*) FILTER (l_returnflag <> 'N' AND l_quantity <= 25) AS b1,
 count(*) FILTER (l_discount >= 0.05) AS c, count(*) FILTER (l_discount >= 0.05 AND l_quantity <= 25) AS c1 FROM lineitem)
SELECT unnest(['all', 'returned', 'confident']) AS filter, unnest([round(100.0 * a1 / a, 2), round(100.0 * b1 / b, 2), round(100.0 * c1 / c, 2)])::DOUBLE AS pct FROM s""")
def watershed_filters(t, spark):
    """The share below a threshold under several filters, counted in one scan."""
    below = F.col("l_quantity") <= 25
    filters = {"all": F.lit(True), "returned": F.col("l_returnflag") != "N", "confident": F.col("l_discount") >= 0.05}
    got = T.stack_metrics(t("lineitem"), {k: F.round(100.0 * F.count_if(c & below) / F.count_if(c), 2) for k, c in filters.items()})
    return got.select(F.col("metric").alias("filter"), F.col("value").alias("pct"))


@query("""
SELECT p_type, count(*) FILTER (l_quantity <= 10) AS low, count(*) FILTER (l_quantity > 10 AND l_quantity <= 40) AS mid, count(*) FILTER (l_quantity > 40) AS high
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def banded_class_counts(t, spark):
    q = F.col("l_quantity")
    li = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return li.groupBy("p_type").agg(F.count_if(q <= 10).alias("low"), F.count_if((q > 10) & (q <= 40)).alias("mid"), F.count_if(q > 40).alias("high"))


@query("""
WITH m AS (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
SELECT count(*) AS materials, count(*) FILTER (top > 50000) AS over_50k, round(100.0 * count(*) FILTER (top > 50000) / count(*), 2)::DOUBLE AS pct FROM m""")
def entity_scarcity(t, spark):
    """How many entities ever pass a threshold."""
    m = t("lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("top"))
    over = F.count_if(F.col("top") > 50000)
    return m.agg(F.count("*").alias("materials"), over.alias("over_50k"), F.round(100.0 * over / F.count("*"), 2).cast("double").alias("pct"))


@query("SELECT (floor(l_quantity / 10) * 10)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_10(t, spark):
    h = histogram(t("lineitem"), "l_quantity", 10)
    return h.select(big(F.col("bin")).alias("bin"), "n")


@query("SELECT (floor(l_quantity / 5) * 5)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_5(t, spark):
    h = histogram(t("lineitem"), "l_quantity", 5)
    return h.select(big(F.col("bin")).alias("bin"), "n")


@query("""
SELECT CASE WHEN o_totalprice < 50000 THEN 'a' WHEN o_totalprice < 150000 THEN 'b' ELSE 'c' END AS band, count(*) AS n, round(min(o_totalprice), 2) AS least
FROM orders GROUP BY 1""")
def case_buckets(t, spark):
    p = F.col("o_totalprice")
    band = F.when(p < 50000, "a").when(p < 150000, "b").otherwise("c")
    return t("orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.min(p), 2).alias("least"))


@query("""
WITH c AS (SELECT p_type, n_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, n_name) AS rank FROM c)
SELECT p_type, n_name, n, rank::INTEGER AS rank FROM r WHERE rank <= 2 AND n >= 10""")
def group_leaders(t, spark):
    """The two leading countries of each family, if they have ten records."""
    j = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    n = j.groupBy("p_type", "n_name").agg(F.count("*").alias("n"))
    return T.top_k(n, ["p_type"], [F.col("n").desc(), F.col("n_name")], 2).where("n >= 10")


@query("""
WITH f AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS fs FROM lineitem GROUP BY 1)
SELECT len(fs)::BIGINT AS flags, count(*) AS n, count(*) FILTER (list_contains(fs, 'R') AND list_contains(fs, 'A')) AS both FROM f GROUP BY 1""")
def multi_membership(t, spark):
    """Papers by the number of families they belong to, and those that belong to two given ones."""
    f = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("fs"))
    both = F.array_contains("fs", "R") & F.array_contains("fs", "A")
    return f.groupBy(big(F.size("fs")).alias("flags")).agg(F.count("*").alias("n"), F.count_if(both).alias("both"))


@query("""
SELECT year(l_shipdate) AS year, count(DISTINCT l_orderkey) FILTER (n_name = 'FRANCE') AS france, count(DISTINCT l_orderkey) FILTER (n_name = 'CHINA') AS china,
 count(DISTINCT l_orderkey) FILTER (n_name = 'FRANCE' AND l_quantity > 25) AS france_high
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def two_countries_by_year(t, spark):
    """Distinct papers of two countries a year, one also above a threshold."""
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    some = lambda c: F.count_distinct(F.when(c, F.col("l_orderkey")))
    fr, cn = F.col("n_name") == "FRANCE", F.col("n_name") == "CHINA"
    return j.groupBy(big(year()).alias("year")).agg(some(fr).alias("france"), some(cn).alias("china"), some(fr & (F.col("l_quantity") > 25)).alias("france_high"))


@query("""
WITH c AS (SELECT o_orderkey, count(DISTINCT s_nationkey) AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT CASE WHEN k = 1 THEN '1' WHEN k = 2 THEN '2' WHEN k = 3 THEN '3' ELSE '4+' END AS countries, count(*) AS papers FROM c GROUP BY 1""")
def countries_per_paper(t, spark):
    """Papers by their number of countries; none falls to the open class, as the report has it."""
    j = t("orders").join(T.spread(t("lineitem"), "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    k = j.groupBy("o_orderkey").agg(F.count_distinct("s_nationkey").alias("k"))
    return k.groupBy(F.when(F.col("k").between(1, 3), F.col("k").cast("string")).otherwise("4+").alias("countries")).agg(F.count("*").alias("papers"))


@query("""
WITH m AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1)
SELECT CASE WHEN k <= 1 THEN '1' WHEN k <= 9 THEN '2-9' WHEN k <= 29 THEN '10-29' ELSE '30+' END AS bucket, count(*) AS materials, sum(k)::BIGINT AS papers FROM m GROUP BY 1""")
def pareto_buckets(t, spark):
    m = t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("k"))
    k = F.col("k")
    return m.groupBy(F.when(k <= 1, "1").when(k <= 9, "2-9").when(k <= 29, "10-29").otherwise("30+").alias("bucket")).agg(F.count("*").alias("materials"), F.sum("k").alias("papers"))


@query("WITH m AS (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1) SELECT k AS papers, count(*) AS materials FROM m GROUP BY 1")
def freq_of_freq(t, spark):
    m = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("papers"))
    return m.groupBy("papers").agg(F.count("*").alias("materials"))


@query("""
SELECT l_partkey, count(DISTINCT l_orderkey) AS papers, round(max(l_extendedprice), 2) AS top FROM lineitem GROUP BY 1 ORDER BY papers DESC, l_partkey LIMIT 25""")
def top_25(t, spark):
    m = t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("papers"), F.round(F.max("l_extendedprice"), 2).alias("top"))
    return m.orderBy(F.col("papers").desc(), "l_partkey").limit(25)


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 60000 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 30""")
def top_30_high(t, spark):
    cols = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return t("lineitem").select(*cols).where("l_extendedprice >= 60000").orderBy(F.col("l_extendedprice").desc(), *cols[:2]).limit(30)


@query("""
SELECT CASE WHEN p_name ILIKE '%steel%' THEN 'steel' WHEN p_name ILIKE '%copper%' THEN 'copper' WHEN p_name ILIKE '%brass%' THEN 'brass' ELSE 'other' END AS named,
 min(year(l_shipdate)) AS first_year, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def named_first_year(t, spark):
    """First year and counts of things named by a list of patterns."""
    name = F.col("p_name")
    named = F.when(name.ilike("%steel%"), "steel").when(name.ilike("%copper%"), "copper").when(name.ilike("%brass%"), "brass").otherwise("other")
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(named.alias("named")).agg(big(F.min(year())).alias("first_year"), F.count("*").alias("n"))


@query("""
SELECT DISTINCT l_returnflag, l_linestatus, year(l_shipdate) AS year FROM lineitem""")
def distinct_tuples(t, spark):
    return t("lineitem").select("l_returnflag", "l_linestatus", big(year()).alias("year")).distinct()


@query("""
WITH b AS (SELECT (floor(l_extendedprice / 1000) * 1000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT bin, n, (SELECT max(n) FROM b x WHERE x.bin BETWEEN b.bin - 30000 AND b.bin - 5000) AS left_peak,
 (SELECT max(n) FROM b x WHERE x.bin BETWEEN b.bin + 5000 AND b.bin + 30000) AS right_peak FROM b)
SELECT bin, n, left_peak, right_peak, round(n / least(left_peak, right_peak), 4) AS depth FROM s WHERE left_peak IS NOT NULL AND right_peak IS NOT NULL""")
def valley_depth(t, spark):
    """Density valleys of a histogram by range windows on either side."""
    h = histogram(t("lineitem"), "l_extendedprice", 1000)
    return valleys(h.select(big(F.col("bin")).alias("bin"), "n"), near=5000, far=30000).where("left_peak is not null and right_peak is not null")


@query("""
WITH a AS (SELECT p_brand, count(*) AS n, max(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1996 GROUP BY 1),
b AS (SELECT p_brand, count(*) AS n, max(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1997 GROUP BY 1)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, CASE WHEN a.p_brand IS NULL THEN 'added' WHEN b.p_brand IS NULL THEN 'removed'
 WHEN a.n IS DISTINCT FROM b.n OR a.q IS DISTINCT FROM b.q THEN 'changed' ELSE 'same' END AS side,
 CASE WHEN a.p_brand IS NULL OR b.p_brand IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.q IS DISTINCT FROM b.q THEN 'q' END) END AS changed
FROM a FULL JOIN b ON a.p_brand = b.p_brand""")
def snapshot_diff(t, spark):
    """Two snapshots: what was added, removed or changed, and in which columns."""
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda y: j.where(year() == y).groupBy("p_brand").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return T.diff(side(1996), side(1997), ["p_brand"], ["n", "q"]).withColumn("changed", F.array_join("changed", ","))


@query("""
SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags, bool_or(l_linestatus = 'O') AS open_, median(l_quantity)::DOUBLE AS mid FROM lineitem GROUP BY 1""")
def grouped_lists(t, spark):
    """Distinct values as one ordered text, any-true and the exact median."""
    return t("lineitem").groupBy("l_suppkey").agg(
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("flags"), F.bool_or(F.col("l_linestatus") == "O").alias("open_"), F.median("l_quantity").cast("double").alias("mid")
    )


@query("""
WITH c AS (SELECT l_suppkey, l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT l_suppkey, l_returnflag, sum(n) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS k FROM k)
SELECT l_suppkey, l_returnflag AS winner FROM r WHERE k = 1""")
def mode_by_group(t, spark):
    from lodestone.operators.evidence import majority

    return majority(t("lineitem"), "l_suppkey", "l_returnflag")


@query("""
SELECT 'all' AS scope, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'open_urgent', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'open_not_urgent', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def set_operations(t, spark):
    o = t("orders")
    keys = lambda c: o.where(c).select("o_orderkey")
    open_, urgent = keys("o_orderstatus = 'O'"), keys("o_orderpriority = '1-URGENT'")
    rows = {"all": o, "open": open_, "open_urgent": open_.intersect(urgent), "open_not_urgent": open_.exceptAll(urgent).distinct()}
    out = None
    for name, df in rows.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT count(*) AS papers, sum((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey))::BIGINT AS records, strftime(max(o_orderdate), 'v%Y.%m.%d') AS version FROM orders""")
def dataset_version(t, spark):
    n = t("lineitem").agg(F.count("*").alias("records"))
    v = T.versioned(t("orders"), "o_orderdate")
    return t("orders").agg(F.count("*").alias("papers")).join(n, F.lit(True)).join(v, F.lit(True))
