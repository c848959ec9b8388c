"""Queries over recognition results. Runs are synthetic: documents as runs, eight at a time as a batch (an engine each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import layout as L
from inkmill.operators import ranking as K
from inkmill.plans.base import query

HTML = r"""array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</t[dh]>\s*', chr(9), 'g'), '</tr>\s*', chr(10), 'g'), '</(?:p|div|h[1-6]|li)>\s*', chr(10), 'g'), '<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
 '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[ \t]+|[ \t]+$', '', 'g')), lambda x: regexp_matches(x, '[^\s\p{Z}]')), chr(10))"""


@query("ocr_html_to_text", f"SELECT page_id, {HTML} AS text FROM pages")
def html(spark, tables):
    return tables("pages").select("page_id", L.html_to_text(F.col("html")).alias("text"))


@query("ocr_split_pages", "SELECT doc_id, pos::INTEGER AS pos, trim(string_split(text, chr(10))[pos + 1], chr(10)) AS page FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)")
def pages(spark, tables):
    docs = tables("documents")
    merged = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\n"), i, F.lit("-" * 48 + "\n"), x))), "")
    return docs.select("doc_id", F.posexplode(L.split_pages(merged)).alias("pos", "page"))


@query("ocr_reading_order", """SELECT doc_id // 16 AS page, doc_id, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY round_even((n_chars % 1000) / 1000.0 / 0.02, 0), -((doc_id % 97) / 97.0 + 0.5), doc_id)::INTEGER AS pos FROM documents""")
def order(spark, tables):
    box = F.struct(((F.col("doc_id") % 97) / 97.0).alias("x0"), ((F.col("n_chars") % 1000) / 1000.0).alias("y0"), ((F.col("doc_id") % 97) / 97.0 + 0.5).alias("x1"), F.lit(1.0).alias("y1"))
    blocks = tables("documents").select(F.expr("doc_id div 16").alias("page"), F.struct("doc_id", box.alias("bbox")).alias("b")).groupBy("page").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    return blocks.select("page", F.posexplode(L.reading_order(F.col("blocks"), F.lit(True))).alias("p", "b")).select("page", "b.doc_id", (F.col("p") + 1).alias("pos"))


STATUS = "CASE doc_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'cancelled' ELSE CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END END"


@query("ocr_batch_status", f"""WITH r AS (SELECT doc_id // 4 AS batch_id, {STATUS} AS status FROM documents)
SELECT batch_id, CASE WHEN bool_or(status IN ('queued', 'running')) THEN CASE WHEN bool_or(status = 'succeeded') THEN 'partial' ELSE 'running' END WHEN bool_or(status = 'succeeded') THEN 'done' WHEN bool_and(status = 'cancelled') THEN 'cancelled' ELSE 'failed' END AS batch_status FROM r GROUP BY batch_id""")
def status(spark, tables):
    runs = tables("documents").select(F.expr("doc_id div 4").alias("batch_id"), F.expr(STATUS).alias("status"))
    return K.batch_status(runs)


@query("ocr_rank_runs", """WITH r AS (SELECT doc_id // 8 AS batch_id, doc_id AS run_id, (doc_id % 11) / 10.0 AS conf, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (n_chars % 100) / 100.0 END AS gib, doc_id % 9 = 0 AS sus FROM documents)
SELECT batch_id, run_id, row_number() OVER (PARTITION BY batch_id ORDER BY round(0.35 * coalesce(conf, 0.5) + 0.65 * (1 - coalesce(gib, 0.5)) - CASE WHEN sus THEN 0.3 ELSE 0 END, 9) DESC, run_id)::INTEGER AS place FROM r""")
def rank(spark, tables):
    from pyspark.sql import Window

    runs = tables("documents").select(F.expr("doc_id div 8").alias("batch_id"), F.col("doc_id").alias("run_id"), ((F.col("doc_id") % 11) / 10.0).alias("conf"), F.when(F.col("doc_id") % 5 != 0, (F.col("n_chars") % 100) / 100.0).alias("gib"), (F.col("doc_id") % 9 == 0).alias("sus"))
    key = F.round(K.rank_key(F.col("conf"), F.col("gib"), F.col("sus")), 9)
    return runs.select("batch_id", "run_id", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc(key), "run_id")).alias("place"))


@query("ocr_suspected_summaries", """WITH r AS (SELECT doc_id // 8 AS batch_id, doc_id AS run_id, length(text) AS n, list_sort(list_filter(list(length(text)) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda c: c > 0)) AS before FROM documents)
SELECT batch_id, run_id, coalesce(n < 0.4 * before[len(before) // 2 + 1], false) AS suspected FROM r""")
def summaries(spark, tables):
    runs = tables("documents").select(F.expr("doc_id div 8").alias("batch_id"), F.col("doc_id").alias("run_id"), F.col("doc_id").alias("finished_at"), F.length("text").alias("char_count"), F.lit(0.2).alias("gibberish"))
    return K.flag_summaries(runs).select("batch_id", "run_id", "suspected")


@query("ocr_best_run", """SELECT source AS batch_id, arg_min(doc_id, (g, doc_id)) AS run_id FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE round(length(regexp_replace(text, '[^ ]', '', 'g')) / length(text), 6) END AS g FROM documents) GROUP BY source""")
def best(spark, tables):
    share = F.round(F.length(F.regexp_replace("text", "[^ ]", "")) / F.length("text"), 6)
    runs = tables("documents").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("run_id"), F.when(F.col("doc_id") % 3 != 0, share).alias("gibberish"))
    return K.best_run(runs).select("batch_id", "run_id")


@query("ocr_compare_grid", """WITH runs AS (SELECT doc_id AS run_id, doc_id // 3 AS batch_id FROM documents WHERE doc_id % 4 <> 1), p AS (SELECT doc_id AS run_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number, unnest(string_split(text, chr(10))) AS text FROM documents),
g AS (SELECT DISTINCT batch_id, page_number FROM p JOIN runs USING (run_id))
SELECT batch_id, g.page_number::INTEGER AS page_number, run_id, length(coalesce(text, ''))::INTEGER AS char_count FROM runs JOIN g USING (batch_id) LEFT JOIN p USING (run_id, page_number)""")
def grid(spark, tables):
    docs = tables("documents")
    runs = docs.select(F.col("doc_id").alias("run_id"), F.expr("doc_id div 3").alias("batch_id"), F.when(F.col("doc_id") % 4 == 1, "failed").otherwise("succeeded").alias("status"), F.lit(0.5).alias("rank_key"))
    pages = docs.select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("run_id", (F.col("i") + 1).alias("page_number"), "text")
    return K.compare(runs, pages).select("batch_id", "page_number", "run_id", "char_count")


@query("ocr_words_to_lines", """SELECT l_orderkey AS block, 0 AS par, 0 AS line, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text, min(l_quantity) AS x0, max(l_extendedprice) AS x1, round(avg(greatest(l_tax * 1000 - 20, 0)) / 100, 9) AS confidence FROM lineitem GROUP BY l_orderkey""")
def lines(spark, tables):
    words = tables("lineitem").select(F.col("l_orderkey").alias("block"), F.lit(0).alias("par"), F.lit(0).alias("line"), F.lit(5).alias("level"), F.col("l_linenumber").alias("word"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), F.col("l_extendedprice").alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_tax") * 1000 - 20).alias("conf"))
    return K.words_to_lines(words).select("block", "par", "line", "text", "x0", "x1", F.round("confidence", 9).alias("confidence"))
