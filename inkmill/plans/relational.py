"""Queries over the relational idioms, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmill.functions import conversation as K
from inkmill.operators import relational as R
from inkmill.plans.base import query
from inkmill.sources import tables as S


@query("rel_count_children", "SELECT c_custkey, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def children(spark, tables):
    return R.count_children(tables("customer").select("c_custkey"), tables("orders"), "c_custkey", "o_custkey")


@query("rel_filters", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND (contains(lower(c_name), '00') OR contains(lower(o_orderpriority), 'urgent'))")
def filters(spark, tables):
    rows = tables("orders").join(tables("customer"), F.col("c_custkey") == F.col("o_custkey"))
    mine = (F.col("c_mktsegment") == "BUILDING") & F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000)
    return rows.filter(mine & (R.contains_either("00", F.col("c_name")) | R.contains_either("URGENT", F.col("o_orderpriority")))).select("o_orderkey")


@query("rel_overlap_filter", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR list_has_any(string_split(text, ' '), ['tion', 'the'])")
def overlap(spark, tables):
    words = F.split("text", " ")
    return tables("documents").filter(R.contains_either("SRC1", F.col("source")) | F.arrays_overlap(words, F.array(F.lit("tion"), F.lit("the")))).select("doc_id")


@query("rel_json_predicate", "SELECT event_id, json_extract_string(props, '$.k') AS ref FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL OR value IS NULL")
def json(spark, tables):
    ref = F.get_json_object("props", "$.k")
    return tables("events").filter(ref.isNotNull() | F.col("value").isNull()).select("event_id", ref.alias("ref"))


@query("rel_next_numbers", "SELECT o_orderkey, coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey % 7 + 1) AS m FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) ON k = o_custkey WHERE o_orderkey % 3 <> 0")
def numbers(spark, tables):
    orders = tables("orders").select("o_custkey", "o_orderkey")
    old = orders.filter("o_orderkey % 3 = 0").withColumn("number", F.col("o_orderkey") % 7 + 1)
    return R.next_numbers(old, orders.filter("o_orderkey % 3 <> 0"), "o_custkey", "number", "o_orderkey").select("o_orderkey", "number")


@query("rel_keep_first_and_last", "SELECT user_id, event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def first_last(spark, tables):
    rows = tables("events").filter("value IS NOT NULL").select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    first = R.keep_one(rows, keys, "event_id").select(*keys, F.col("value").alias("first"))
    return first.join(R.keep_one(rows, keys, "event_id", False).select(*keys, F.col("value").alias("last")), keys)


@query("rel_best_answer", "SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def best(spark, tables):
    rows = tables("orders").withColumn("arrival", F.col("o_orderkey"))
    return R.best_answer(rows, ["o_custkey"], "o_totalprice", "arrival", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("rel_join_pages", "SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def pages(spark, tables):
    return R.join_text(tables("conversations"), ["conv_id"], "turn", "text", "\f")


@query("rel_nested_children", "SELECT n_nationkey, len(list_filter(list(s_suppkey), lambda x: x IS NOT NULL)) AS n, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1")
def nested(spark, tables):
    nations = tables("nation").select("n_nationkey")
    suppliers = tables("supplier").filter("s_acctbal > 0").withColumnRenamed("s_nationkey", "n_nationkey")
    rows = R.nest(nations, suppliers, "n_nationkey", "suppliers", "s_suppkey", ["s_name"])
    return rows.select("n_nationkey", F.size("suppliers").cast("long").alias("n"), F.array_join(F.transform("suppliers", lambda s: s["s_name"]), ",").alias("names"))


@query("rel_ordered_lookup", "SELECT pos, c_name FROM (VALUES (0, 7), (1, 3), (2, 999999999), (3, 11)) AS w(pos, k) JOIN customer ON c_custkey = k")
def lookup(spark, tables):
    wanted = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (7, 3, 999999999, 11)]).alias("ids"))
    return R.in_order(wanted, "ids", tables("customer"), "c_custkey").select("pos", "c_name")


@query("rel_missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, tables):
    return R.missing(tables("documents"), tables("labels"), "doc_id")


@query("rel_siblings", "SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def siblings(spark, tables):
    return R.siblings(tables("supplier"), "s_nationkey", "s_suppkey")


@query("rel_zip_lists", "SELECT doc_id, len(list_zip(string_split(text, ' '), string_split(lang || ' ' || source, ' '), true))::INTEGER AS n, string_split(text, ' ')[1] || '=' || lang AS first FROM documents")
def zipped(spark, tables):
    pairs = R.zip_shorter(F.split("text", " "), F.split(F.concat("lang", F.lit(" "), "source"), " "))
    return tables("documents").select("doc_id", F.size(pairs).alias("n"), F.concat(pairs[0]["a"], F.lit("="), pairs[0]["b"]).alias("first"))


@query("rel_coverage", "SELECT source, count(*) AS n, round(avg(CASE WHEN length(text) > 1000 THEN 1.0 ELSE 0.0 END), 6) AS coverage, avg(CASE WHEN length(text) > 1000 THEN 1.0 ELSE 0.0 END) >= 0.6 AS covered FROM documents GROUP BY source")
def coverage(spark, tables):
    return R.coverage(tables("documents"), ["source"], F.length("text") > 1000).withColumn("coverage", F.round("coverage", 6))


@query("rel_upper_median", "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey")
def median(spark, tables):
    from inkmill.operators.ranking import upper_median_by

    return upper_median_by(tables("lineitem"), ["l_suppkey"], "l_quantity")


@query("rel_tail", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def tail(spark, tables):
    return R.tail(tables("conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn")


@query("rel_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged(spark, tables):
    return R.page(tables("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("rel_rank_in_list", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END::BIGINT AS place FROM orders")
def listed(spark, tables):
    return tables("orders").select("o_orderkey", R.rank_in_list(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).cast("long").alias("place"))


@query("rel_cumulative_budget", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 500 AS fits FROM conversations")
def budget(spark, tables):
    running = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return tables("conversations").select("conv_id", "turn", (running <= 500).alias("fits"))


@query("rel_files_that_fit", """WITH RECURSIVE f AS (SELECT s_nationkey AS k, s_name AS name, (s_acctbal * 100)::BIGINT + 1000000 AS size, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
r AS (SELECT DISTINCT k, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, '' AS names FROM f UNION ALL SELECT r.k, f.i, CASE WHEN n < 10 AND used + size <= 2000000 THEN used + size ELSE used END, CASE WHEN n < 10 AND used + size <= 2000000 THEN n + 1 ELSE n END, CASE WHEN n < 10 AND used + size <= 2000000 THEN names || name || ',' ELSE names END FROM r JOIN f ON f.k = r.k AND f.i = r.i + 1)
SELECT k AS nation, arg_max(names, i) AS names FROM r GROUP BY k""")
def files(spark, tables):
    rows = tables("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_name").alias("name"), ((F.col("s_acctbal") * 100).cast("decimal(18,2)").cast("decimal(18,0)").cast("long") + 1_000_000).alias("size")))).alias("files"))
    return rows.select("nation", F.array_join(F.transform(K.fit_files(F.col("files"), total=2_000_000), lambda n: F.concat(n, F.lit(","))), "").alias("names"))


@query("sink_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_name FROM customer UNION ALL SELECT -1, 5.0, NULL")
def upserted(spark, tables):
    old = tables("customer").select("c_custkey", "c_acctbal", "c_name")
    new = old.filter("c_custkey % 10 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).union(spark.sql("SELECT CAST(-1 AS bigint), 5.0D"))
    return S.upsert(old, new, ["c_custkey"])


@query("sink_get_or_create", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def created(spark, tables):
    return S.get_or_create(tables("labels").select("doc_id", "quality"), tables("documents").select("doc_id", F.lit(1).alias("quality")), ["doc_id"])


@query("sink_replace_by_key", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_mktsegment = 'BUILDING'")
def replaced(spark, tables):
    new = tables("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("o_orderkey"))
    return S.replace_by_key(tables("orders").select("o_custkey", "o_orderkey"), new, ["o_custkey"])


@query("sink_update_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def updated(spark, tables):
    return S.update_where(tables("orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", o_orderstatus=F.lit("cancelled"))


@query("sink_erase", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def erased(spark, tables):
    rows = tables("conversations").select("conv_id", "turn", "role")
    return S.erase(rows, rows.filter("role = 'system'"), "conv_id", "conv_id").select("conv_id", "turn")


@query("rel_tpch_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def pricing(spark, tables):
    rows = tables("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
