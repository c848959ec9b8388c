"""Queries over ownership, revisions, reports, dialogue and search with filters, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import conversation as K
from inkmill.functions import edits as G
from inkmill.functions import layout as L
from inkmill.functions import metadata as E
from inkmill.functions import records as P
from inkmill.functions import text as T
from inkmill.operators import chunking as C
from inkmill.operators import dialogue as D
from inkmill.operators import lifecycle as M
from inkmill.operators import ranking as K2
from inkmill.operators import relational as R
from inkmill.operators import retrieval as V
from inkmill.plans.base import query
from inkmill.plans.retrieval import PHRASE, TERM, TRI, chunks_of, first_vector
from inkmill.sources import tables as S


@query("rel_with_any", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def with_any(spark, tables):
    return R.with_any(tables("customer").select("c_custkey"), tables("orders").filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey")


@query("rel_owned", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def owned(spark, tables):
    orders = tables("orders").select("o_orderkey", F.col("o_custkey").alias("document_id"))
    return R.owned(orders, tables("customer").select(F.col("c_custkey").alias("document_id"), "c_nationkey"), "document_id", "c_nationkey", 7).select("o_orderkey")


@query("rel_stale_uploads", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NULL AND ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def stale(spark, tables):
    events = tables("events").select("event_id", "ts", F.get_json_object("props", "$.k").alias("owner"))
    return events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))).filter(P.stale_unbound(F.col("owner"), F.col("ts"), F.col("now"))).select("event_id")  # one row


@query("lifecycle_adopt_runs", """WITH n AS (SELECT o_custkey AS d, max(o_orderkey % 5 + 1) AS m FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT o_custkey AS document_id, coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision_no, o_orderkey AS origin_run, 'selected ' || o_orderpriority AS note
FROM orders LEFT JOIN n ON d = o_custkey WHERE o_orderkey % 4 = 1 AND o_orderstatus = 'F'""")
def adopted(spark, tables):
    orders = tables("orders")
    runs = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"), F.lit("t").alias("text"), F.col("o_orderpriority").alias("engine"))
    revisions = orders.filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 5 + 1).alias("revision_no"))
    return M.adopt_runs(runs.filter("run_id % 4 = 1").select("document_id", "run_id"), runs, revisions).select("document_id", "revision_no", "origin_run", "note")


@query("lifecycle_finalize", """WITH r AS (SELECT l_orderkey AS d, l_linenumber AS no, l_linenumber = 1 AS f FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
w AS (SELECT o_orderkey AS d, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 + o_orderkey % 4 END AS no FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT w.* FROM w JOIN r USING (d, no))
SELECT r.d AS document_id, r.no AS revision_no, CASE WHEN t.no IS NULL THEN r.f ELSE r.no = t.no END AS is_final FROM r LEFT JOIN t ON t.d = r.d""")
def finalized(spark, tables):
    revisions = tables("lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("revision_no")).distinct().withColumn("is_final", F.col("revision_no") == 1)
    key = F.col("o_orderkey")
    chosen = tables("orders").filter("o_orderkey % 2 = 0").select(key.alias("document_id"), F.when(key % 3 == 0, 0).otherwise(1 + key % 4).cast("int").alias("revision_no"), F.lit(2).alias("current_no"))
    return M.finalize(revisions, chosen).select("document_id", "revision_no", "is_final")


@query("edits_report_totals", "SELECT l_suppkey AS job_id, count(*) AS pages, sum(l_linenumber)::BIGINT AS proposed, sum(l_linenumber - 1)::BIGINT AS accepted, count(*) AS rejected, sum(l_quantity)::BIGINT AS chars_touched, count(*) FILTER (l_quantity > 40) AS needs_review FROM lineitem GROUP BY 1")
def totals(spark, tables):
    line = F.col("l_linenumber")
    reports = tables("lineitem").select(F.col("l_suppkey").alias("job_id"), line.alias("proposed"), (line - 1).alias("accepted"), F.lit(1).alias("rejected"), F.col("l_quantity").alias("chars_touched"), (F.col("l_quantity") > 40).alias("needs_review"))
    return K2.report_totals(reports)


@query("ocr_compare_columns", """WITH runs AS (SELECT doc_id AS run_id, doc_id // 3 AS batch_id FROM documents WHERE doc_id % 4 <> 1), p AS (SELECT doc_id AS run_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number, unnest(string_split(text, chr(10))) AS text FROM documents),
g AS (SELECT DISTINCT batch_id, page_number FROM p JOIN runs USING (run_id))
SELECT batch_id, g.page_number::INTEGER AS page_number, count(*)::INTEGER AS n_columns, string_agg(run_id::VARCHAR, ',' ORDER BY run_id) AS run_ids, sum(length(coalesce(text, '')))::INTEGER AS char_count FROM runs JOIN g USING (batch_id) LEFT JOIN p USING (run_id, page_number) GROUP BY 1, 2""")
def columns(spark, tables):
    docs = tables("documents")
    runs = docs.select(F.col("doc_id").alias("run_id"), F.expr("doc_id div 3").alias("batch_id"), F.when(F.col("doc_id") % 4 == 1, "failed").otherwise("succeeded").alias("status"), F.lit(0.5).alias("rank_key"))
    pages = docs.select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("run_id", (F.col("i") + 1).alias("page_number"), "text")
    sizes = F.aggregate("columns", F.lit(0), lambda n, c: n + c["char_count"])
    return K2.compare_grid(runs, pages).select("batch_id", "page_number", F.size("columns").alias("n_columns"), F.array_join(F.transform("columns", lambda c: c["run_id"].cast("string")), ",").alias("run_ids"), sizes.alias("char_count"))


@query("ocr_batch_states", "SELECT n_nationkey AS batch_id, CASE WHEN count(s_suppkey) = 0 THEN 'queued' WHEN bool_or(s_acctbal > 0) THEN 'done' ELSE 'failed' END AS batch_status, CASE WHEN count(s_suppkey) > 0 AND bool_or(s_acctbal > 0) THEN 'ocr_done' ELSE 'ocr_failed' END AS state FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_nationkey % 3 <> 0 GROUP BY 1")
def batch_states(spark, tables):
    runs = tables("supplier").filter("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("batch_id"), F.when(F.col("s_acctbal") > 0, "succeeded").otherwise("failed").alias("status"))
    rows = K2.with_status(tables("nation").select(F.col("n_nationkey").alias("batch_id")), runs)
    return rows.select("batch_id", "batch_status", K2.target_state(F.col("batch_status")).alias("state"))


@query("ocr_catalog_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal > 0 DESC, s_nationkey, s_acctbal, s_name)::INTEGER AS place FROM supplier")
def catalog(spark, tables):
    engines = tables("supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("available"), F.col("s_nationkey").alias("tier"), F.col("s_acctbal").alias("seconds"), F.col("s_name").alias("name"))
    ordered = R.catalog_order(engines).agg(F.collect_list("s_suppkey").alias("ids"))  # a catalog: one row an engine
    return ordered.select(F.posexplode("ids").alias("place", "s_suppkey")).select("s_suppkey", (F.col("place") + 1).alias("place"))


@query("records_terminal", """SELECT event_id, s IN ('succeeded', 'failed', 'timeout', 'cancelled', 'skipped') AS terminal, CASE WHEN s = 'unavailable' THEN 'preprocess' ELSE s END AS stage
FROM (SELECT event_id, ['succeeded', 'failed', 'timeout', 'cancelled', 'skipped', 'unavailable', 'running', 'enrich'][event_id % 8 + 1] AS s FROM events)""")
def terminal(spark, tables):
    states = F.array(*map(F.lit, ["succeeded", "failed", "timeout", "cancelled", "skipped", "unavailable", "running", "enrich"]))
    s = F.get(states, (F.col("event_id") % 8).cast("int"))
    return tables("events").select("event_id", P.is_terminal(s).alias("terminal"), F.when(s == "unavailable", "preprocess").otherwise(s).alias("stage"))


@query("records_small", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title, CASE WHEN doc_id % 5 <> 0 THEN 'expected 0 pages, got ' || doc_id % 5 END AS warning, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS patched,
 CASE WHEN doc_id % 4 = 0 THEN 'uploaded' WHEN doc_id % 4 IN (1, 2) THEN ['enrich', 'index'][doc_id % 4] END AS retry, CASE WHEN doc_id % 7 < 3 THEN CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE '' END ELSE 'all' END AS scope, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || '… output truncated' ELSE text END AS output FROM documents""")
def small(spark, tables):
    i = F.col("doc_id")
    stage = F.when(i % 4 == 0, "preprocess").when(i % 4 == 1, "enrich").when(i % 4 == 2, "index").otherwise("other")
    scope = P.scope_ids(F.when(i % 7 < 3, "selected").otherwise("all"), F.when(i % 2 == 0, F.array("lang", "source")))
    return tables("documents").select(
        i, P.title_of(F.when(i % 3 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("title"), P.page_count_warning(F.lit(0), (i % 5).cast("int")).alias("warning"),
        P.patched(F.when(i % 2 == 0, F.col("lang")), F.col("source")).alias("patched"), M.retry_state(stage).alias("retry"), F.coalesce(F.array_join(scope, ","), F.lit("all")).alias("scope"), K.clipped(F.col("text")).alias("output"),
    )


@query("records_planned_fields", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE '' END AS fields, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS first_value, array_to_string(list_filter([lang, source], lambda k: k = lang), ',') AS accepted FROM documents")
def planned(spark, tables):
    both = F.array("lang", "source")
    entries = F.array(F.struct(F.lit("a:1").alias("key"), F.col("lang").alias("value")), F.struct(F.when(F.col("doc_id") % 3 == 0, "b:1").otherwise("a:2").alias("key"), F.col("source").alias("value")))
    fields = F.transform(both, lambda k: F.struct(k.alias("key")))
    return tables("documents").select("doc_id", F.array_join(P.planned_fields(F.when(F.col("doc_id") % 2 == 0, "advanced").otherwise("auto"), both), ",").alias("fields"), P.by_prefix(entries, "b").alias("first_value"), F.array_join(F.transform(P.accepted_fields(fields, F.array("lang")), lambda f: f["key"]), ",").alias("accepted"))


@query("records_provenance", "SELECT doc_id, lang AS model, source AS text_source, doc_id % 4 AS revision_no, 'v1' AS prompt_version, len(string_split(text, chr(10))) > 1 AS condensed FROM documents")
def provenance(spark, tables):
    return tables("documents").select("doc_id", P.provenance(F.col("lang"), F.col("source"), F.col("doc_id") % 4, F.lit("v1"), F.size(F.split("text", "\n"))).alias("p")).select("doc_id", "p.*")


@query("sink_saved_files", "SELECT doc_id, source AS name, octet_length(encode(text)) AS size, md5(text) AS digest FROM documents WHERE doc_id % 5 <> 0")
def saved(spark, tables):
    body = F.when(F.col("doc_id") % 5 == 0, "no base64!").otherwise(F.base64(F.encode("text", "utf-8")))
    return tables("documents").select("doc_id", P.saved_file(F.col("source"), body).alias("f")).filter("f IS NOT NULL").select("doc_id", "f.name", F.col("f.size").cast("long").alias("size"), F.md5("f.content").alias("digest"))


@query("layout_pixels", "SELECT doc_id, trunc((doc_id % 10) / 10::DOUBLE * 800)::INTEGER AS x0, trunc((n_chars % 7) / 7::DOUBLE * 600)::INTEGER AS y0 FROM documents")
def pixels(spark, tables):
    box = F.struct(((F.col("doc_id") % 10) / 10.0).alias("x0"), ((F.col("n_chars") % 7) / 7.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    return tables("documents").select("doc_id", L.to_pixels(box, F.lit(800), F.lit(600)).alias("b")).select("doc_id", F.get("b", F.lit(0)).alias("x0"), F.get("b", F.lit(1)).alias("y0"))


@query("vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.7f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def literals(spark, tables):
    return tables("embeddings").select("vec_id", T.vector_literal(F.col("embedding")).alias("literal"))


@query("edits_chosen_pages", "SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '[^\\s\\p{Z}]') AND (doc_id % 2 = 0 OR i % 2 = 1)), lambda i: i || ':' || p[i]), '|') AS chosen FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def chosen(spark, tables):
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("number"), t.alias("text")))
    odd = F.filter(F.sequence(F.lit(1), F.size(F.split("text", "\n"))), lambda n: n % 2 == 1)
    kept = G.chosen_pages(pages, F.when(F.col("doc_id") % 2 == 1, odd))
    return tables("documents").select("doc_id", F.array_join(F.transform(kept, lambda p: F.concat(p["number"].cast("string"), F.lit(":"), p["text"])), "|").alias("chosen"))


@query("edits_overlap_rule", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'overlap' END AS first_rule, CASE WHEN doc_id % 3 = 1 THEN 'overlap' END AS second_rule FROM documents WHERE length(text) > 12 AND doc_id % 3 < 3")
def overlap_rule(spark, tables):
    change = lambda s, e, c: F.struct(F.lit(s).alias("span_start"), F.lit(e).alias("span_end"), F.substring("text", s + 1, e - s).alias("original"), F.lit("x").alias("replacement"), c.alias("confidence"))
    third = F.col("doc_id") % 3
    judged = lambda c: F.struct(c.alias("c"), F.lit(None).cast("string").alias("rule"))
    # Of two proposals over the same letters the one of higher confidence wins; in every third text they lie apart.
    near = F.array(judged(change(0, 6, F.when(third == 0, 0.5).otherwise(0.9))), judged(change(4, 9, F.lit(0.7))))
    apart = F.array(judged(change(0, 4, F.lit(0.9))), judged(change(4, 9, F.lit(0.7))))
    rows = tables("documents").filter(F.length("text") > 12).select("doc_id", G.with_overlaps(F.when(third == 2, apart).otherwise(near)).alias("j"))
    return rows.select("doc_id", F.get("j", F.lit(0))["rule"].alias("first_rule"), F.get("j", F.lit(1))["rule"].alias("second_rule"))


@query("enrich_kept_windows", """WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
r AS (SELECT doc_id, p, 1::BIGINT AS i, 1::BIGINT AS n, length(p[1]) AS used, p[1] = '' AS blank FROM p
 UNION ALL SELECT doc_id, p, i + 1, CASE WHEN NOT blank AND used + length(p[i + 1]) > 8000 THEN n + 1 ELSE n END, CASE WHEN NOT blank AND used + length(p[i + 1]) > 8000 THEN length(p[i + 1]) WHEN blank THEN length(p[i + 1]) ELSE used + 1 + length(p[i + 1]) END,
  CASE WHEN NOT blank AND used + length(p[i + 1]) > 8000 THEN p[i + 1] = '' WHEN blank THEN p[i + 1] = '' ELSE false END FROM r WHERE i < len(p))
SELECT doc_id, least(max(n), 8)::INTEGER AS windows FROM r GROUP BY doc_id""")
def kept_windows(spark, tables):
    return tables("documents").select("doc_id", F.size(E.kept_windows(F.replace("text", F.lit("\n"), F.lit("\f")))).alias("windows"))


@query("chunk_index", """SELECT d.doc_id, l.quality, e.label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON vec_id = doc_id""")
def index(spark, tables):
    chunked = tables("documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")
    meta = tables("labels").select(F.col("doc_id").alias("document_id"), "quality")
    vectors = tables("embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "label")
    return C.indexed(chunked, meta, vectors).select(F.col("document_id").alias("doc_id"), "quality", "label")


@query("chunk_reindexed", "SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber < 3 THEN 'S' || chr(10) || l_returnflag ELSE l_linestatus END AS text FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber < 3 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber < 3)")
def reindexed(spark, tables):
    rows = tables("lineitem")
    old = rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_linestatus").alias("text"))
    new = rows.filter("l_orderkey % 5 = 0 AND l_linenumber < 3").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), C.embed_text(F.lit("S"), F.col("l_returnflag")).alias("text"))
    return S.replace_by_key(old, new, ["document_id"])


@query("chat_modes", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END AS mode, greatest(1, least(50, event_id % 70 - 5))::INTEGER AS top_k FROM events")
def modes(spark, tables):
    return tables("events").select("event_id", K.mode_of(F.col("event_type"), ["view", "click"], "view").alias("mode"), K.clamp_top_k((F.col("event_id") % 70 - 5).cast("int")).alias("top_k"))


@query("chat_message_text", "SELECT conv_id, turn, text || chr(10) || '[image]' AS message FROM conversations")
def message(spark, tables):
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text")))
    return tables("conversations").select("conv_id", "turn", K.message_text(parts).alias("message"))


@query("chat_answerable", "SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE NOT (turn = m AND role = 'assistant')")
def answerable(spark, tables):
    calls = F.when(F.col("role") == "assistant", F.array(F.lit("search"))).otherwise(F.array().cast("array<string>"))
    return D.answerable(tables("conversations").withColumn("tool_calls", calls)).select("conv_id", "turn")


HITS = "SELECT user_id AS conv_id, event_type AS chunk_id, max(event_id) AS document_id, arg_max(value, event_id) AS score FROM events GROUP BY 1, 2"


def hits_of(tables):
    e = tables("events")
    return D.collected_hits(e.select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("chunk_id"), F.col("event_id").alias("arrival"), F.col("event_id").alias("document_id"), F.col("props").alias("document_title"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.repeat("props", F.lit(40)).alias("text"), F.col("value").alias("score")))


@query("chat_collected_hits", HITS)
def collected(spark, tables):
    return hits_of(tables).select("conv_id", "chunk_id", "document_id", "score")


@query("chat_citation_records", f"WITH h AS ({HITS}), t AS (SELECT h.*, props FROM h JOIN events ON event_id = document_id) SELECT conv_id, CASE chunk_id WHEN 'click' THEN 1 ELSE 2 END::INTEGER AS n, chunk_id, document_id, props AS title, substring(repeat(props, 40), 1, 240) AS quote, score FROM t WHERE chunk_id IN ('click', 'view')")
def cited(spark, tables):
    hits = hits_of(tables)
    # Ids that were never retrieved cite nothing; numbers follow the answer's order.
    answers = hits.select("conv_id").distinct().select("conv_id", F.array(F.lit("click"), F.lit("view"), F.lit("none")).alias("cited"))
    return D.citation_records(answers, hits).select("conv_id", "n", "chunk_id", "document_id", "title", "quote", "score")


RANKED = f"""SELECT doc_id AS id, {TRI.format('text')} AS a, {TRI.format(f"'{PHRASE}'")} AS b FROM documents JOIN embeddings ON vec_id = doc_id"""


@query("retrieval_fuzzy", f"SELECT id AS chunk_id, round(s, 6) AS score FROM (SELECT id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s FROM ({RANKED})) WHERE s > 0.25 ORDER BY s DESC, id LIMIT 20")
def fuzzy(spark, tables):
    return V.fuzzy(chunks_of(tables), PHRASE, 20).select("chunk_id", F.round("score", 6).alias("score"))


def filtered(where: str) -> str:
    cosine = "(1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"
    return f"""WITH s AS (SELECT * FROM documents JOIN embeddings ON doc_id = vec_id WHERE {where}),
vec AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank_vec FROM (SELECT e.vec_id AS id, {cosine} AS d FROM s e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, id LIMIT 80)),
fts AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank_fts FROM (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w = '{TERM}')) AS n FROM s WHERE contains(lower(text), '{TERM}')) WHERE n > 0 ORDER BY n DESC, id LIMIT 80)
SELECT coalesce(v.id, f.id) AS chunk_id, rank_vec, rank_fts, round(coalesce(1.2 / (60 + rank_vec), 0) + coalesce(1.0 / (60 + rank_fts), 0), 9) AS score FROM vec v FULL JOIN fts f ON v.id = f.id ORDER BY coalesce(1.2 / (60 + rank_vec), 0) + coalesce(1.0 / (60 + rank_fts), 0) DESC, 1 LIMIT 50"""


def shown(found):
    return found.select("chunk_id", "rank_vec", "rank_fts", F.round("score", 9).alias("score"))


@query("retrieval_filtered_search", filtered("lang = 'en' AND source = 'src1'"))
def filtered_search(spark, tables):
    return shown(V.hybrid_search(chunks_of(tables), TERM, first_vector(tables), 50, doc_type="src1", lang="en"))


@query("retrieval_scoped_search", filtered("doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def scoped_search(spark, tables):
    ids = tables("labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    return shown(V.hybrid_search(chunks_of(tables), TERM, first_vector(tables), 50, doc_ids=ids))


@query("retrieval_hint_retry", filtered("true"))
def hint_retry(spark, tables):
    return shown(V.search_with_hints(chunks_of(tables), TERM, first_vector(tables), 50, lang="none such"))


@query("retrieval_postings_search", f"""SELECT id AS chunk_id, row_number() OVER (ORDER BY n DESC, id)::INTEGER AS rank_fts FROM (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w = '{TERM}')) AS n FROM documents WHERE contains(lower(text), '{TERM}')) WHERE n > 0 ORDER BY n DESC, id LIMIT 80""")
def postings_search(spark, tables):
    index_ = V.postings(tables("documents").withColumnRenamed("doc_id", "chunk_id"))
    return V.search_postings(index_, [TERM]).select("chunk_id", "rank_fts")


@query("stream_appended", "SELECT event_id, event_type FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY event_id DESC LIMIT 1) AND event_id > 1000")
def appended(spark, tables):
    """Events go to a table by a stream; a reader that has seen 1000 of them gets the rest by another."""
    from inkmill.session import shared_folder
    from inkmill.streaming import lifecycle as L_

    folder, rows = shared_folder(spark), tables("events").select("event_id", "user_id", "event_type", "ts")
    rows.write.parquet(f"{folder}/source")
    first = L_.read_events(spark, f"{folder}/source", rows.schema)
    L_.append_events(first, f"{folder}/log", f"{folder}/state").awaitTermination()
    logged = spark.read.parquet(f"{folder}/log")
    user = logged.agg(F.max_by("user_id", "event_id")).first()[0]
    later = L_.snapshot_then_tail(spark, f"{folder}/log", logged.schema, "user_id", user, "event_id", 1000)
    return L_.drain(later.select("event_id", "event_type"), "append", f"{folder}/tail")
