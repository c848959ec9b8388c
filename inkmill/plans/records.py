"""Queries over record projections and research turns, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import records as P
from inkmill.operators import research as Q
from inkmill.plans.base import query


@query("records_page_or_message", "SELECT doc_id, CASE WHEN doc_id % 7 BETWEEN 1 AND len(p) THEN p[doc_id % 7] ELSE 'Page ' || (doc_id % 7) || ' is out of range; the document has ' || len(p) || ' page(s).' END AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def pages(spark, tables):
    text = F.replace("text", F.lit("\n"), F.lit("\f"))
    return tables("documents").select("doc_id", P.page_or_message(text, (F.col("doc_id") % 7).cast("int")).alias("page"))


@query("records_settings", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.mode'), 'documents') AS mode FROM events")
def settings(spark, tables):
    return tables("events").select("event_id", P.setting(F.col("props"), "k", "none").alias("k"), P.setting(F.col("props"), "mode", "documents").alias("mode"))


@query("records_failures", "SELECT doc_id, substring(text, 1, 64) AS code, substring(text, 1, 4000) AS message, substring(text, 1, 300) AS event_message, CASE WHEN doc_id % 4 < 2 THEN 5 * (doc_id % 4 + 1) END AS delay FROM documents")
def failures(spark, tables):
    return tables("documents").select("doc_id", P.failure(F.col("text"), F.col("text")).alias("f"), P.retry_delay(F.col("doc_id") % 4).alias("delay")).select("doc_id", "f.*", "delay")


@query("records_filter_meta", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:15], ' ') AS keywords, array_to_string(string_split(text, ' ')[1:10], ' ') AS topics, substring(text, 1, 300) AS title FROM documents")
def meta(spark, tables):
    words = F.split("text", " ")
    return tables("documents").select("doc_id", P.filter_meta(words, words, F.col("text")).alias("m")).select("doc_id", F.array_join("m.keywords", " ").alias("keywords"), F.array_join("m.topics", " ").alias("topics"), "m.title")


@query("records_job_pages", "SELECT doc_id // 16 AS job, coalesce(array_to_string(list_sort(list(doc_id) FILTER (doc_id % 3 = 0)), ','), '') AS pages FROM documents GROUP BY 1")
def job(spark, tables):
    rasters = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("gray"), F.lit("p"))).otherwise(F.create_map(F.lit("color"), F.lit("p")))
    # A job has the pages of one file.
    rows = tables("documents").groupBy(F.expr("doc_id div 16").alias("job")).agg(F.collect_list(F.struct(F.col("doc_id").alias("page_number"), rasters.alias("rasters"))).alias("p"))
    return rows.select("job", F.array_join(P.job_pages(F.col("p"), "gray"), ",").alias("pages"))


@query("records_phase_summary", "SELECT user_id, count(*) FILTER (event_type = 'view') AS n_queries, arg_min(event_id, event_id) FILTER (event_type = 'purchase') AS steps FROM events GROUP BY user_id")
def phases(spark, tables):
    phase = F.when(F.col("event_type") == "view", "searching").when(F.col("event_type") == "purchase", "planned").otherwise("other")
    rows = tables("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", phase.alias("phase"), F.col("props").alias("detail"), F.col("event_id").alias("n")))).alias("p"))
    return rows.select("user_id", P.phase_summary(F.col("p")).alias("s")).select("user_id", F.size("s.queries").cast("long").alias("n_queries"), "s.steps")


@query("research_answers", """WITH b AS (SELECT user_id AS turn_id, event_type AS question, arg_min(event_id, (-value, event_id)) FILTER (value > 0) AS answer, max(value) FILTER (value > 0) AS c FROM events GROUP BY 1, 2)
SELECT turn_id, question, answer, coalesce(round(c, 6), 0) AS confidence, coalesce(c, 0) >= 0.6 AS answered FROM b""")
def answers(spark, tables):
    rows = tables("events").select(F.col("user_id").alias("turn_id"), F.col("event_type").alias("question"), F.col("event_id").alias("answer"), F.col("value").alias("confidence"), F.col("event_id").alias("at"))
    kept = rows
    # Within a step the attempts come in the order of events; attempt numbers above the limit do not occur here.
    steps = kept.select("turn_id", "question").distinct().withColumn("step", F.lit(0))
    checks = kept.withColumn("attempt", -1 / (1 + F.col("at")))
    return Q.answers(steps, checks).select("turn_id", "question", "answer", F.round("confidence", 6).alias("confidence"), "answered")


@query("research_sources", "SELECT turn_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, arrival) AS n FROM (SELECT o_custkey AS turn_id, o_orderpriority AS chunk_id, arg_min(o_totalprice, o_orderkey) AS score, min(o_orderkey) AS arrival FROM orders GROUP BY 1, 2)) WHERE n <= 14")
def sources(spark, tables):
    hits_ = tables("orders").select(F.col("o_custkey").alias("turn_id"), F.col("o_orderpriority").alias("chunk_id"), F.col("o_orderkey").alias("arrival"), F.col("o_totalprice").alias("score"))
    return Q.passages(Q.sources(hits_)).select("turn_id", "chunk_id", "score")


@query("research_first_valid", "SELECT o_custkey, coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 = 0), 'other') AS doc_type, count(*) FILTER (o_orderkey % 3 = 0) = 0 AS degraded FROM orders GROUP BY o_custkey")
def first_valid(spark, tables):
    attempts = tables("orders").select("o_custkey", F.col("o_orderkey").alias("attempt"), (F.col("o_orderkey") % 3 == 0).alias("valid"), F.col("o_orderstatus").alias("doc_type"))
    return Q.first_valid(attempts, "o_custkey", {"doc_type": "other"})


@query("ocr_fan_out_cost", "SELECT s_nationkey AS batch_id, round(sum(p * CASE e WHEN 'fast' THEN 3 ELSE 12 END), 6) AS seconds FROM (SELECT s_nationkey, s_suppkey % 9 AS p, unnest(['fast', 'exact']) AS e FROM supplier) GROUP BY 1")
def cost(spark, tables):
    batches = tables("supplier").select(F.col("s_nationkey").alias("batch_id"), (F.col("s_suppkey") % 9).alias("pages"), F.array(F.lit("fast"), F.lit("exact")).alias("engines"))
    engines = spark.sql("SELECT * FROM VALUES ('fast', 3.0D), ('exact', 12.0D) AS e(engine, seconds)")
    return Q.estimated_cost(Q.fan_out(batches), engines).select("batch_id", F.round("seconds", 6).alias("seconds"))


@query("edits_seen_digits", "SELECT source, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(text, '\\p{Nd}'))))), '') AS digits FROM documents WHERE regexp_matches(text, '\\p{Nd}') GROUP BY source")
def digits(spark, tables):
    return Q.seen_digits(tables("documents"), "source", "text").select("source", F.array_join("digits", "").alias("digits"))


@query("records_missing_and_counts", "SELECT s_nationkey, count(*) AS total, count(*) FILTER (s_acctbal > 0) AS available, array_to_string(list_sort(list_filter(['1', '2', '3', '4'], lambda x: NOT list_contains(list((s_suppkey % 5)::VARCHAR), x))), ',') AS missing FROM supplier GROUP BY 1")
def counted(spark, tables):
    have = F.collect_set((F.col("s_suppkey") % 5).cast("string"))
    rows = tables("supplier").groupBy("s_nationkey").agg(F.count("*").alias("total"), F.count_if(F.col("s_acctbal") > 0).alias("available"), have.alias("have"))
    return rows.select("s_nationkey", "total", "available", F.array_join(P.missing_of(F.array(*map(F.lit, "1234")), F.col("have")), ",").alias("missing"))
