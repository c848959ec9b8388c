"""Queries over loops in rounds and order statistics, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.operators import rounds as Q
from inkmill.operators import selection as S
from inkmill.plans.base import query

#: A question is a kind of event of a user; an attempt's hits and checks are the events whose number leaves that rest by three.
STATE = """s{n} AS (SELECT t, q, CASE WHEN ok AND c > confidence THEN c ELSE confidence END AS confidence, CASE WHEN ok AND c > confidence THEN a ELSE answer END AS answer, {n} AS attempts, ok AS found
 FROM (SELECT x.*, k.c, k.a, x.found OR x.t IN (SELECT o.t FROM o{p} o JOIN hits h ON h.t = o.t AND h.q = o.q WHERE h.attempt = {p} AND o.confidence < 0.6) AS ok FROM o{p} x LEFT JOIN checks k ON k.t = x.t AND k.q = x.q AND k.attempt = {p})),
e{n} AS (SELECT t, CASE WHEN NOT bool_or(found) THEN 'nothing found' WHEN min(confidence) >= 0.6 THEN 'answered' WHEN {n} = 3 THEN 'attempts ended' END AS stopped FROM s{n} GROUP BY t),
o{n} AS (SELECT s.* FROM s{n} s JOIN e{n} e ON e.t = s.t WHERE stopped IS NULL),
d{n} AS (SELECT s.*, stopped FROM s{n} s JOIN e{n} e ON e.t = s.t WHERE stopped IS NOT NULL)"""


@query("research_rounds", """WITH hits AS (SELECT user_id AS t, event_type AS q, event_id % 3 AS attempt FROM events WHERE value > 60),
checks AS (SELECT user_id AS t, event_type AS q, event_id % 3 AS attempt, max(value / 90) AS c, arg_max(event_id, (value, -event_id)) AS a FROM events GROUP BY 1, 2, 3),
o0 AS (SELECT DISTINCT user_id AS t, event_type AS q, 0.0::DOUBLE AS confidence, NULL::BIGINT AS answer, 0 AS attempts, false AS found FROM events WHERE event_type IS NOT NULL), """ + ", ".join(STATE.format(n=n, p=n - 1) for n in (1, 2, 3)) + " " + " UNION ALL ".join(f"SELECT t AS turn_id, q AS question, round(confidence, 9) AS confidence, answer, attempts, stopped FROM d{n}" for n in (1, 2, 3)))
def research(spark, tables):
    events = tables("events").filter("event_type IS NOT NULL").select(F.col("user_id").alias("turn_id"), F.col("event_type").alias("question"), (F.col("event_id") % 3).cast("int").alias("attempt"), "event_id", "value")
    kinds = events.select("question").distinct().collect()  # some five kinds of events
    number = F.create_map(*[x for n, r in enumerate(sorted(r[0] for r in kinds)) for x in (F.lit(r), F.lit(n))])
    steps = events.select("turn_id", "question").distinct().select("turn_id", number[F.col("question")].alias("step"), "question", F.concat(F.col("question"), F.lit("#0")).alias("query"))
    others = steps.crossJoin(F.broadcast(spark.range(1, 3).select(F.col("id").cast("int").alias("attempt")))).withColumn("query", F.concat("question", F.lit("#"), "attempt"))  # two rows
    found = events.filter("value > 60").select("turn_id", F.concat("question", F.lit("#"), "attempt").alias("query"), F.col("event_id").alias("chunk_id"))
    checks = events.groupBy("turn_id", "question", "attempt").agg(F.max(F.col("value") / 90).alias("confidence"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("answer"))
    done, _ = Q.research(steps, others, lambda asked: asked.join(found, ["turn_id", "query"]).select("turn_id", "chunk_id"), checks)
    return done.select("turn_id", "question", F.round("confidence", 9).alias("confidence"), "answer", "attempts", "stopped")


@query("enrich_ladder", """SELECT doc_id, CASE WHEN doc_id % 9 < 8 THEN lang ELSE 'other' END AS record, least(CASE WHEN doc_id % 9 < 2 THEN 1 WHEN doc_id % 9 < 4 THEN 2 WHEN doc_id % 9 < 6 THEN 3 ELSE 4 END, 4) AS attempts, doc_id % 9 >= 6 AS is_partial,
 CASE WHEN doc_id % 9 < 6 THEN '' WHEN doc_id % 9 < 8 THEN 'metadata_degraded' ELSE 'metadata_degraded,metadata_unavailable' END AS flags FROM documents""")
def ladder(spark, tables):
    """Two calls, a repair that knows the error, a call for less, and the floor."""
    docs = tables("documents").select("doc_id", "lang")
    rest = F.col("doc_id") % 9
    call = lambda below: lambda open_: open_.select("doc_id", (rest < below).alias("valid"), F.col("lang").alias("record"), F.concat(F.lit("error of "), rest.cast("string")).alias("error"))
    repair = lambda open_: open_.select("doc_id", ((rest < 6) & (F.col("error") == F.concat(F.lit("error of "), rest.cast("string")))).alias("valid"), F.col("lang").alias("record"), "error")
    found = Q.ladder(docs, "doc_id", [call(2), call(4), repair, call(8)], floor=lambda open_: open_.select("doc_id", F.lit("other").alias("record")))
    return found.select("doc_id", "record", "attempts", "is_partial", F.array_join("quality_flags", ",").alias("flags"))


@query("rel_hot_median", "SELECT source, list_sort(list(length(text)))[count(text) // 2 + 1] AS median FROM documents WHERE text IS NOT NULL GROUP BY source")
def hot_median(spark, tables):
    """All sources are counted in bins, none is sorted."""
    return S.upper_median_of(tables("documents").select("source", F.length("text").alias("n_letters")), ["source"], "n_letters", hot=0)


@query("rel_quantiles", "SELECT l_returnflag, list_sort(list(l_extendedprice))[(count(*) * 9) // 10 + 1] AS price FROM lineitem GROUP BY 1")
def quantiles(spark, tables):
    """The ninth decile of three keys with all rows, by counting passes."""
    return S.kth_by(tables("lineitem"), ["l_returnflag"], "l_extendedprice", F.floor(F.col("n") * 9 / 10), "price")


def with_pages(tables):
    """Documents as revisions: lines are pages, parted by form feeds."""
    return tables("documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("revision_id"), F.regexp_replace("text", "\n", "\f").alias("text"))


def model(chunks):
    """In place of an embedding model: four numbers of a text's digest."""
    part = lambda k: F.conv(F.substring(F.md5("embed_text"), 1 + 4 * k, 4), 16, 10).cast("float")
    return chunks.select("document_id", "chunk_index", F.array(*[part(k) for k in range(4)]).alias("embedding"))


@query("chunk_pipeline")
def pipeline(spark, tables):
    """All documents are indexed; then every third one again with a new text. Tests hold it against chunks made one by one."""
    from inkmill.operators.indexing import index_revisions

    meta, first = tables("documents").select(F.col("doc_id").alias("document_id"), "source"), with_pages(tables)
    index, _ = index_revisions(first, meta, model)
    again = first.filter("document_id % 3 = 0").withColumn("text", F.upper("text"))
    index, _ = index_revisions(again, meta, model, index)
    return index.select("document_id", "chunk_index", "page_start", "page_end", "token_count", "source", F.md5("text").alias("digest"), F.col("embedding")[0].alias("first"))


@query("chunk_runs", r"""SELECT doc_id AS document_id, 'failed' AS status, 'no finalized text' AS error FROM documents WHERE doc_id % 5 = 0 OR NOT regexp_matches(text, '[^\s\p{Z}]')""")
def runs(spark, tables):
    """What was not indexed for want of text: every fifth document has none."""
    from inkmill.operators.indexing import index_revisions

    revisions = with_pages(tables).withColumn("text", F.when(F.col("document_id") % 5 != 0, F.col("text")))
    _, found = index_revisions(revisions, tables("documents").select(F.col("doc_id").alias("document_id")), model)
    return found.filter("error = 'no finalized text'").select("document_id", "status", "error")


@query("ocr_compare_agreement", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number FROM documents), g AS (SELECT *, doc_id % 3 <> 0 AND regexp_matches(t, '[^\s\p{Z}]') AS same FROM p)
SELECT doc_id AS batch_id, page_number::INTEGER AS page_number, CASE WHEN same THEN 1.0 ELSE 0.0 END AS agreement, CASE WHEN same AND length_grapheme(t) >= 12 THEN '0-' || length(t) ELSE '' END AS spans FROM g""")
def agreement(spark, tables):
    """Two engines for each document: they agree on every page of two documents of three, and on nothing of the third."""
    from inkmill.operators.ranking import compare_grid

    lines = tables("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("page_number", F.col("i") + 1)
    other = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "(?s).", "☃")).otherwise(F.col("text"))
    pages = lines.select((F.col("doc_id") * 2).alias("run_id"), "page_number", "text").unionByName(lines.select((F.col("doc_id") * 2 + 1).alias("run_id"), "page_number", other.alias("text")))
    docs = tables("documents").select("doc_id")
    runs_ = docs.select(F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("run_id"), F.col("doc_id").alias("batch_id")).withColumns({"status": F.lit("succeeded"), "rank_key": F.lit(0.5)})
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["s"], s["e"])), ",")
    return compare_grid(runs_, pages).select("batch_id", "page_number", "agreement", spans.alias("spans"))
