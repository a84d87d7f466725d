"""Consensus, rules, joins, text, vectors and streaming twins on the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers, text
from lodestone.operators import agreement as A
from lodestone.operators import evidence as E
from lodestone.operators import rules, statistics, timeline, vectors
from lodestone.operators import tables as T
from lodestone.sources.articles import chunks
from lodestone.streaming import jobs

from .registry import query

big = lambda c: c.cast("long")


@query("""
WITH p AS (SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
s AS (SELECT a.l_suppkey, a.v, (SELECT count(*) FROM p b WHERE b.l_suppkey = a.l_suppkey AND b.v >= a.v) AS reach, n FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n FROM p) a)
SELECT l_suppkey, max(v) AS value, CASE WHEN any_value(n) < 5 THEN any_value(n) ELSE min(reach) END AS support FROM s
WHERE reach >= CASE WHEN n < 5 THEN 1 ELSE greatest(2, least(10, n // 20)) END GROUP BY 1""")
def corroborated_max(t, spark):
    """The highest value that enough papers reach, a supplier."""
    return E.corroborated_max(t("lineitem"), "l_suppkey", "l_orderkey", "l_extendedprice")


@query("""
WITH r AS (SELECT l_partkey, l_orderkey, lower(l_returnflag) AS k, l_returnflag AS said, least(1.0, greatest(0.0, l_discount * 10)) AS w FROM lineitem),
v AS (SELECT l_partkey, k, sum(w) AS w, count(DISTINCT l_orderkey) AS voters, any_value(said) AS said FROM r GROUP BY 1, 2),
a AS (SELECT l_partkey, count(*) AS n FROM r GROUP BY 1), s AS (SELECT v.*, n, sum(w) OVER (PARTITION BY l_partkey) AS total,
 row_number() OVER (PARTITION BY l_partkey ORDER BY round(w, 9) DESC, k) AS rank FROM v JOIN a USING (l_partkey))
SELECT l_partkey, CASE WHEN (n < 2 OR voters >= 2) AND (total <= 0 OR round(w / total, 9) >= 0.6) THEN said END AS winner FROM s WHERE rank = 1""")
def weighted_mode(t, spark):
    """The confidence-weighted text of each part, if it is a consensus."""
    li = t("lineitem").withColumn("conf", F.col("l_discount") * 10)
    return E.weighted_mode(li, "l_partkey", "l_orderkey", "l_returnflag", "conf")


@query("""
WITH s AS (SELECT l_partkey, sum(CASE WHEN l_linestatus = 'F' THEN least(1.0, greatest(0.0, l_discount * 10)) ELSE 0 END) AS t,
 sum(CASE WHEN l_linestatus <> 'F' THEN least(1.0, greatest(0.0, l_discount * 10)) ELSE 0 END) AS f FROM lineitem GROUP BY 1),
q AS (SELECT l_partkey, round(t / nullif(t + f, 0), 9) AS t, round(f / nullif(t + f, 0), 9) AS f FROM s)
SELECT l_partkey, CASE WHEN t >= 0.7 AND f < 0.2 THEN true WHEN f >= 0.7 AND t < 0.2 THEN false END AS flag FROM q""")
def weighted_boolean(t, spark):
    li = t("lineitem").withColumns({"conf": F.col("l_discount") * 10, "closed": F.col("l_linestatus") == "F"})
    return E.weighted_flag(li, "l_partkey", "closed", "conf")


@query("""
SELECT l_partkey, arg_min(l_returnflag, (l_orderkey * 100 + l_linenumber)) FILTER (l_returnflag <> 'N') AS first_flag,
 arg_min(l_returnflag, (year(l_shipdate) * 1000000000000 + l_orderkey * 100 + l_linenumber)) FILTER (l_returnflag <> 'N') AS earliest_flag,
 arg_max(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) AS argmax_order FROM lineitem GROUP BY 1""")
def ordered_picks(t, spark):
    """First and earliest filled values and the record of the maximum, in a total order."""
    li = t("lineitem").withColumns({"flag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "year": F.year("l_shipdate")})
    order = ["l_orderkey", "l_linenumber"]
    top = F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber")))
    return li.groupBy("l_partkey").agg(E.first_filled("flag", order).alias("first_flag"), E.earliest_filled("flag", "year", order).alias("earliest_flag"), top.alias("argmax_order"))


@query("""
SELECT l_partkey, coalesce(count(l_extendedprice) >= 2 AND (max(l_extendedprice) - min(l_extendedprice)) / max(l_extendedprice) > 0.3, false) AS disputed,
 CASE WHEN count(*) FILTER (l_returnflag = 'N') = count(*) THEN 'cited_only'
 WHEN count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0) >= 0.75 THEN 'experimental'
 WHEN count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0) >= 0.75 THEN 'theoretical'
 WHEN count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'A') > 0 THEN 'mixed' END AS dominant FROM lineitem GROUP BY 1""")
def dispute_and_dominance(t, spark):
    return t("lineitem").groupBy("l_partkey").agg(
        E.spread_dispute("l_extendedprice").alias("disputed"), E.dominance(F.col("l_returnflag") == "N", F.col("l_returnflag") == "A").alias("dominant")
    )


@query("""
WITH caps(p_type, cap) AS (SELECT p_type, round(avg(p_size) * 1.5) FROM part GROUP BY 1)
SELECT p_partkey, p_type, p_size::BIGINT AS p_size FROM part WHERE EXISTS (SELECT 1 FROM caps WHERE caps.p_type = part.p_type AND p_size > cap)""")
def cap_violations(t, spark):
    """Rows above the cap of their group."""
    caps = t("part").groupBy("p_type").agg(F.round(F.avg("p_size") * 1.5).alias("cap"))
    return rules.violations(t("part").select("p_partkey", "p_type", big(F.col("p_size")).alias("p_size")), caps, "p_type", "p_size", "cap")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_discount < 0.02)""")
def array_exists_rule(t, spark):
    """Orders with a record that breaks a rule, tested inside their nested records."""
    nested = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_discount")).alias("r"))
    return nested.where(F.exists("r", lambda r: (r["l_quantity"] > 45) & (r["l_discount"] < 0.02))).select(F.col("l_orderkey").alias("o_orderkey"))


@query("""
SELECT l_partkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 0 AND count(*) = count(*) FILTER (o_totalprice > 10000)""")
def sole_source(t, spark):
    """Parts all of whose orders pass a test."""
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy("l_partkey").agg((F.count("*") == F.count_if(F.col("o_totalprice") > 10000)).alias("all_")).where("all_").select("l_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphans(t, spark):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH b AS (SELECT DISTINCT p_brand FROM part), k AS (SELECT p_brand, left(p_brand, length(p_brand) - 1) || '1' AS parent FROM b),
l AS (SELECT k.p_brand, x.p_brand AS parent FROM k LEFT JOIN b x ON x.p_brand = k.parent AND k.parent <> k.p_brand)
SELECT p_brand, parent, nullif((SELECT count(*) FROM l y WHERE y.parent = l.p_brand), 0) AS variants FROM l""")
def parent_variant(t, spark):
    """A self-join on a computed parent key, only where the parent exists, and the variants of each parent."""
    b = t("part").select("p_brand").distinct()
    k = b.withColumn("_p", F.concat(F.expr("left(p_brand, length(p_brand) - 1)"), F.lit("1")))
    linked = k.join(b.select(F.col("p_brand").alias("parent")), (F.col("_p") == F.col("parent")) & (F.col("parent") != F.col("p_brand")), "left").drop("_p")
    n = linked.where("parent is not null").groupBy(F.col("parent").alias("_v")).agg(F.count("*").alias("variants"))
    return linked.join(n, F.col("p_brand") == F.col("_v"), "left").drop("_v")


@query("""
WITH s AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)
SELECT a.r AS a, b.r AS b, round((SELECT count(*) FROM s x JOIN s y USING (l_partkey) WHERE x.l_returnflag = a.r AND y.l_returnflag = b.r)
 / (SELECT count(DISTINCT l_partkey) FROM s WHERE l_returnflag IN (a.r, b.r)), 6) AS jaccard
FROM (SELECT DISTINCT l_returnflag AS r FROM s) a JOIN (SELECT DISTINCT l_returnflag AS r FROM s) b ON a.r < b.r""")
def pairwise_jaccard(t, spark):
    return A.pairwise_jaccard(t("lineitem"), "l_returnflag", "l_partkey")


@query("""
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'),
n AS (SELECT (SELECT count(*) FROM a JOIN b USING (l_partkey)) AS tp, (SELECT count(*) FROM b ANTI JOIN a USING (l_partkey)) AS fp, (SELECT count(*) FROM a ANTI JOIN b USING (l_partkey)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n""")
def prf1(t, spark):
    rows = t("lineitem")
    return A.precision_recall(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["l_partkey"])


@query("""
WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = 1) AS q1, count(*) FILTER (toxic = 1) AS t1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT n::BIGINT AS items, round((same / n - (q1 * t1 + (n - q1) * (n - t1)) / (n * n)) / (1 - (q1 * t1 + (n - q1) * (n - t1)) / (n * n)), 6) AS kappa FROM n""")
def cohen_kappa(t, spark):
    return A.cohen(t("labels"), "quality", "toxic")


@query("""
WITH c AS (SELECT l_orderkey, l_returnflag AS l, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_orderkey, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY 1 HAVING sum(n) = 4), s AS (SELECT l, sum(n) AS n FROM c SEMI JOIN p USING (l_orderkey) GROUP BY 1),
k AS (SELECT count(*) AS items, avg((sq - 4) / 12) AS po FROM p), e AS (SELECT sum(n::DOUBLE * n) / (sum(n)::DOUBLE ** 2) AS pe FROM s)
SELECT items, round((po - pe) / (1 - pe), 6) AS kappa FROM k, e""")
def fleiss_kappa(t, spark):
    """Four raters an item: the orders of four lines, their flags as labels."""
    return A.fleiss(t("lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", 4)


@query("""
WITH v AS (SELECT l_orderkey AS i, l_returnflag AS v FROM lineitem), m AS (SELECT i, count(*) AS m FROM v GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT i, v, m, count(*)::DOUBLE AS c FROM v JOIN m USING (i) GROUP BY ALL), o AS (SELECT sum(c * (m - c) / (m - 1)) AS o FROM c),
n AS (SELECT sum(n) AS n, sum(n * n) AS sq FROM (SELECT v, sum(c) AS n FROM c GROUP BY 1))
SELECT n::BIGINT AS values, round(1 - (o / n) / ((n * n - sq) / (n * (n - 1))), 6) AS alpha FROM o, n""")
def kripp_alpha(t, spark):
    return A.alpha(t("lineitem"), "l_orderkey", "l_returnflag")


@query("""
WITH v AS (SELECT l_orderkey AS i, l_quantity AS v FROM lineitem), m AS (SELECT i, count(*)::DOUBLE AS m, sum(v) AS s, sum(v * v) AS q FROM v GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT sum(m) AS n, sum(2 * (m * q - s * s) / (m - 1)) AS o, sum(s) AS s, sum(q) AS q FROM m)
SELECT n::BIGINT AS values, round(1 - (o / n) / (2 * (n * q - s * s) / (n * (n - 1))), 6) AS alpha FROM t""")
def kripp_alpha_interval(t, spark):
    return A.alpha(t("lineitem"), "l_orderkey", "l_quantity", interval=True)


@query("""
SELECT l_partkey, year(l_shipdate) AS year, round_even(l_extendedprice / 1000, 0)::BIGINT AS price, arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS l_orderkey
FROM lineitem GROUP BY 1, 2, 3""")
def timeline_dedup(t, spark):
    """One point a part, year and rounded price: the first by key."""
    rows = t("lineitem").select("l_partkey", big(F.year("l_shipdate")).alias("year"), big(F.bround(F.col("l_extendedprice") / 1000, 0)).alias("price"), "l_orderkey", "l_linenumber")
    return T.keep_first(rows, ["l_partkey", "year", "price"], [F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_linenumber")


@query("""
SELECT p_partkey, p_type, p_retailprice, (SELECT count(*) FROM part WHERE p_size >= 10 AND p_type IN ('STANDARD', 'PROMO')) AS total FROM part
WHERE p_size >= 10 AND p_type IN ('STANDARD', 'PROMO') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 40""")
def paged_list(t, spark):
    """One page under optional filters, with the number of all hits."""
    where = rules.conjunction(F.col("p_size") >= 10, F.col("p_type").isin("STANDARD", "PROMO"), None)
    rows = t("part").where(where).select("p_partkey", "p_type", "p_retailprice")
    total = rows.agg(F.count("*").alias("total"))
    return T.page(rows, [F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey")], 40, 20).join(total, F.lit(True))


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_orderpriority IS NULL OR o_orderpriority <> '5-LOW') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50""")
def review_queue(t, spark):
    open_ = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") != "5-LOW"))
    return T.page(t("orders").where(open_).select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 0, 50)


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, q WHERE label < 3 AND vec_id <> 7 ORDER BY list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10""")
def knn_topk(t, spark):
    """Ten nearest to one vector among those that a filter leaves."""
    one = t("embeddings").where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vectors.few_knn(one, t("embeddings"), 10, where=F.col("label") < 3)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query("""
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def knn_batch(t, spark):
    """Five nearest to each of a stated set of queries against all rows."""
    e = t("embeddings")
    near = vectors.batch_knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 5)
    return near.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("""
WITH o AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 20),
d AS (SELECT query_id, vec_id, label, list_cosine_distance(e::DOUBLE[], embedding::DOUBLE[]) AS d FROM o JOIN embeddings ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)
SELECT label, round(1 - avg(d), 6) AS similarity, count(*) AS hits FROM r WHERE rank <= 8 AND label <> 1 GROUP BY 1 ORDER BY avg(d), label LIMIT 3""")
def similar_by_label(t, spark):
    """More like this: the groups nearest to one group by the mean distance of its members' hits."""
    return vectors.more_like_this(t("embeddings"), "label", [1], 3)


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 400 THEN 'too_long' WHEN NOT regexp_matches(text, '[A-Z]') THEN 'no_upper'
 WHEN regexp_matches(text, '[0-9]') THEN 'digits' END AS reason FROM documents""")
def ordered_reasons(t, spark):
    """The first reason in a fixed order, null for rows that pass."""
    x = F.col("text")
    return t("documents").select("doc_id", F.coalesce(
        F.when(x.isNull() | (F.trim(x) == ""), "empty"), F.when(F.char_length(F.trim(x)) > 400, "too_long"), F.when(~x.rlike("[A-Z]"), "no_upper"), F.when(x.rlike("[0-9]"), "digits"),
    ).alias("reason"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i) the ') THEN 'the' END,
 CASE WHEN regexp_matches(text, '(?i) und ') THEN 'und' END], lambda x: x IS NOT NULL)), ',') AS tags FROM documents""")
def tag_match(t, spark):
    found = text.tags(F.col("text"), {"licence": "licen[sc]e", "the": " the ", "und": " und "})
    return t("documents").select("doc_id", F.array_join(found, ",").alias("tags"))


@query("""
WITH h AS (SELECT doc_id, (contains(lower(text), ' the '))::INT + (contains(lower(text), ' and '))::INT + (contains(lower(text), ' of '))::INT AS a,
 (contains(lower(text), ' der '))::INT + (contains(lower(text), ' und '))::INT + (contains(lower(text), ' les '))::INT AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN a >= 2 AND a >= b THEN 'x' WHEN b >= 2 THEN 'y' ELSE 'z' END AS class FROM h""")
def keyword_class(t, spark):
    kind = text.keyword_class(F.col("text"), (" the ", " and ", " of "), (" der ", " und ", " les "), ("x", "y", "z"))
    return t("documents").where("text is not null").select("doc_id", kind.alias("class"))


@query("""
SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) > 50, false) AS high FROM events""")
def json_guarded_field(t, spark):
    """A JSON field read with a guarded cast; rows without a number give null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t("events").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("high"))


@query("""
SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS used, greatest(0, 3 - count(*)) AS remaining, count(*) > 3 AS over FROM events GROUP BY 1, 2""")
def daily_quota(t, spark):
    """The batch twin of the streaming quota: uses a day and user, what is left of three."""
    return jobs.daily_counts(t("events"), "user_id", jobs.QUOTA["guest"])


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT (d + i::INTEGER)::DATE AS last_day, event_type, n FROM e, generate_series(0, 6) g(i))
SELECT last_day, event_type, sum(n)::BIGINT AS used FROM w GROUP BY 1, 2""")
def trailing_7d(t, spark):
    return jobs.trailing_counts(t("events"), "event_type")


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY 1")
def retention_prune(t, spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return jobs.retained(t("events"), now, 10).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (value > 30) AS ok, count(*) FILTER (value > 30) / count(*) >= 0.66 AS good FROM events GROUP BY 1""")
def ok_ratio(t, spark):
    return jobs.good_batches(t("events"), "user_id", F.col("value") > 30)


@query("""
SELECT user_id, min(ts)::TIMESTAMP AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1""")
def first_event(t, spark):
    """Each key once, the earliest event: the batch twin of the de-duplicating stream."""
    return jobs.once(t("events").select("user_id", "ts", "event_id"), "user_id")


@query("""
WITH r AS (SELECT user_id, event_id, ts, value < 30 AS f, sum(CASE WHEN value < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS k FROM r WHERE f) SELECT user_id, event_id, k::INTEGER AS streak FROM s WHERE k = 3""")
def failure_alerts(t, spark):
    """Where a key has failed three times in a row."""
    return jobs.alerts(t("events"), "user_id", F.col("value") < 30, ["ts", "event_id"]).select("user_id", "event_id", "streak")


@query("""
WITH c AS (SELECT event_type AS rule_name, CAST(ts AS DATE) AS started_at, count(*) AS rows_flagged FROM events GROUP BY 1, 2)
SELECT rule_name, started_at, rows_flagged, rows_flagged - lag(rows_flagged) OVER (PARTITION BY rule_name ORDER BY started_at) AS delta FROM c""")
def run_deltas(t, spark):
    """Each run's count against the one before."""
    runs = t("events").groupBy(F.col("event_type").alias("rule_name"), F.to_date("ts").alias("started_at")).agg(F.count("*").alias("rows_flagged"))
    return rules.deltas(runs)


@query("""
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY regexp_replace(lower(text), '[^a-z0-9]', '', 'g') HAVING count(*) > 1""")
def near_dup_signature(t, spark):
    """Groups of texts that differ in punctuation and case only."""
    sig = F.sha2(formulas.signature(F.col("text")), 256)
    return t("documents").where("text is not null").groupBy(sig.alias("s")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("s")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem)
SELECT l_partkey, l_orderkey, l_quantity FROM l WHERE k = 1""")
def latest_per_key(t, spark):
    cols = ["l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"]
    return T.latest(t("lineitem").select(*cols), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_quantity")


@query("""
WITH n AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS bal FROM customer), o AS (SELECT c_custkey + 7 AS id, 'old' AS seg, 0.0::DOUBLE AS bal FROM customer)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.seg ELSE n.seg END AS seg, CASE WHEN o.id IS NULL THEN n.bal ELSE o.bal END AS bal FROM o FULL JOIN n ON o.id = n.id""")
def upsert_rows(t, spark):
    """Insert or update one column of a table by key; the other column keeps its old value."""
    c = t("customer")
    old = c.select((F.col("c_custkey") + 7).alias("id"), F.lit("old").alias("seg"), F.lit(0.0).alias("bal"))
    new = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return T.upsert(old, new, ["id"], ["seg"])


@query("""
WITH w AS (SELECT o_orderkey AS id, o_custkey FROM orders), h AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT id, o_custkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM c) THEN 404 WHEN id IN (SELECT id FROM h) THEN 409 ELSE 201 END AS status FROM w""")
def guarded_insert(t, spark):
    """What a guarded insert says of each wanted row: added, there already, or without a target."""
    o = t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    targets = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return T.guarded_insert(t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), o, targets, ["id"], "o_custkey")


@query("""
SELECT doc_id, left(regexp_replace(trim(text), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'), 60) AS start FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def snippets(t, spark):
    s = F.regexp_replace(F.trim("text"), r"[ \t\n\r\x0B\f]+", " ")
    return t("documents").where("text is not null").select("doc_id", F.substring(s, 1, 60).alias("start"))


def _rows_only(f):
    """Register a query that SQL cannot express."""
    return query()(f)


@_rows_only
def chunk_windows(t, spark):
    """Documents packed to overlapping chunks of 512 words."""
    return chunks(t("documents").withColumn("name", F.col("lang")), 512, 64).select("doc_id", "chunk", "tokens")


@query("""
WITH c AS (SELECT k::DOUBLE AS v, count(*)::DOUBLE AS c FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_partkey) GROUP BY 1),
t AS (SELECT v, c, sum(c) OVER (ORDER BY v DESC) AS n, sum(c * ln(v)) OVER (ORDER BY v DESC) AS l FROM c),
b AS (SELECT v AS low, n AS tail, 1 + n / (l - n * ln(v - 0.5)) AS alpha FROM t WHERE n >= 10 AND v < (SELECT max(v) FROM c)),
d AS (SELECT low, tail, alpha, max(abs(pow((v + 0.5) / (low - 0.5), 1 - alpha) - (n - c) / tail)) AS d FROM b JOIN t ON v >= low GROUP BY ALL)
SELECT round(arg_min(alpha, (round(d, 12), low)), 6) AS alpha, arg_min(low, (round(d, 12), low)) AS x_min, round(min(d), 6) AS distance, arg_min(tail, (round(d, 12), low))::BIGINT AS tail FROM d""")
def power_law_fit(t, spark):
    """The best power law in how many lines the parts have."""
    m = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("k"))
    return statistics.power_law(m, "k").withColumns({"alpha": F.round("alpha", 6), "distance": F.round("distance", 6)})


@query("""
WITH c AS (SELECT l_quantity::DOUBLE AS v, count(*)::DOUBLE AS c FROM lineitem WHERE l_quantity >= 5 GROUP BY 1), m AS (SELECT sum(c * v) / sum(c) - 4.5 AS s FROM c),
g AS (SELECT c, ln(1.5 / 4.5) - 2.5 * ln(v / 4.5) + ln(s) + (v - 4.5) / s AS g FROM c, m) SELECT round(sum(c * g), 4) AS ratio FROM g""")
def tail_likelihood(t, spark):
    """A power law against an exponential tail."""
    return statistics.tail_ratio(t("lineitem"), "l_quantity", 5.0, 2.5).select(F.round("ratio", 4).alias("ratio"))


@_rows_only
def bootstrap_mean(t, spark):
    return statistics.bootstrap(t("lineitem"), "l_quantity", replicates=400)


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
 '[\s\p{Z}]+', ' ', 'g')) AS text FROM pages""")
def markup_plain(t, spark):
    """Pages as plain text."""
    return t("pages").select("page_id", text.plain_markup(F.col("html")).alias("text"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS tc, l_quantity / 20 AS lam, l_tax AS mu, l_extendedprice / 100 AS o FROM lineitem),
e AS (SELECT *, lam - mu * (1 + 0.62 * lam) AS low, CASE WHEN lam - mu * (1 + 0.62 * lam) > 0 THEN o / 1.2 * exp(-1.04 * (1 + lam) / (lam - mu * (1 + 0.62 * lam))) END AS est FROM x)
SELECT l_orderkey, l_linenumber, round(est, 3) AS estimate, concat_ws(',', CASE WHEN low <= 0 THEN 'allen_dynes_denominator_nonpositive' END, CASE WHEN tc > 0 AND abs(est - tc) / greatest(tc, 1) > 0.6 THEN 'allen_dynes_mismatch' END) AS flags FROM e""")
def coupling_check(t, spark):
    """A physical estimate against a stated value, with the flags it raises."""
    lam, mu, omega = F.col("l_quantity") / 20, F.col("l_tax"), F.col("l_extendedprice") / 100
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numbers.coupling_estimate(lam, mu, omega), 3).alias("estimate"),
        F.array_join(numbers.coupling_flags(F.col("l_quantity"), lam, mu, omega), ",").alias("flags"),
    )


@query("""
SELECT CASE WHEN l_linenumber % 3 = 0 THEN false WHEN l_linenumber % 3 = 1 THEN true ELSE l_returnflag = 'R' AND l_tax > 0 END AS theory, count(*) AS n FROM lineitem GROUP BY 1""")
def timeline_theory(t, spark):
    said = F.element_at(F.array(F.lit(" ARPES"), F.lit("Eliashberg"), F.lit("unknown")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    kind = timeline.is_theory(said, F.when(F.col("l_returnflag") == "R", "theoretical"), F.col("l_tax"))
    return t("lineitem").groupBy(kind.alias("theory")).agg(F.count("*").alias("n"))
