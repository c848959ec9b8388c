"""Queries over conversations and lifecycle events. Event types stand for states: a synthetic mapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmill.functions import conversation as K
from inkmill.operators import dialogue as D
from inkmill.operators import lifecycle as M
from inkmill.plans.base import query

STATES = {"signup": ["view", "click"], "view": ["click", "purchase", "error"], "click": ["view", "purchase"], "purchase": ["view"], "error": ["signup", "view"]}
ALLOWED = " OR ".join(f"(f = '{a}' AND s IN ({', '.join(repr(b) for b in bs)}))" for a, bs in STATES.items())


@query("chat_bounded_context", "WITH m AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, count(*) FILTER (n > 4 AND back > 2) AS summarised, coalesce(substring(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (n > 4 AND back > 2), 1, 8000), '') AS old FROM m GROUP BY conv_id")
def context(spark, tables):
    return D.bounded_context(tables("conversations"), 4, 2)  # the supplied conversations are short


@query("chat_history", "WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last FROM conversations GROUP BY conv_id), m AS (SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS back FROM conversations c JOIN l USING (conv_id) WHERE (c.role = 'user' OR c.role = 'assistant' AND c.text <> '') AND c.turn < coalesce(l.last, 1000000)) SELECT conv_id, turn FROM m WHERE back <= 6")
def history(spark, tables):
    return D.history(tables("conversations").withColumn("tool_calls", F.array().cast("array<string>"))).select("conv_id", "turn")


@query("chat_last_request", "SELECT conv_id, arg_max(text, turn) AS request FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last(spark, tables):
    return D.last_request(tables("conversations"))


@query("chat_routing", """SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN 'finalize' WHEN conv_id % 2 = 0 THEN CASE WHEN turn >= 4 THEN 'force_answer' ELSE 'general_tools' END ELSE CASE WHEN turn >= CASE conv_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 8 END THEN 'force_answer' ELSE 'tools' END END AS route,
 CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'deep_think' ELSE 'agent' END WHEN conv_id % 3 = 2 THEN 'deep_research' ELSE 'agent' END AS path, CASE conv_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 10 END AS top_k FROM conversations""")
def routing(spark, tables):
    c = F.col
    research = F.when(c("conv_id") % 3 == 0, "fast").when(c("conv_id") % 3 == 1, "balanced").otherwise("deep")
    chat = F.when(c("conv_id") % 2 == 0, "general").otherwise("documents")
    return tables("conversations").select("conv_id", "turn", K.route(c("role") == "assistant", chat, research, c("turn")).alias("route"), K.path(chat, F.when(c("turn") % 2 == 0, "deep").otherwise("think"), research).alias("path"), K.by_mode(research, K.TOP_K).alias("top_k"))


@query("chat_sse_frames", "SELECT conv_id, turn, 'id: ' || turn || chr(10) || 'event: ' || role || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame, text AS back FROM conversations")
def frames(spark, tables):
    rows = tables("conversations")
    frame = K.sse_frame(F.col("role"), F.col("text"), F.col("turn"))
    return rows.select("conv_id", "turn", frame.alias("frame"), K.sse_parse(frame)[0]["data"].alias("back"))


@query("chat_tool_phases", "SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN n = 0 THEN 'searching' ELSE 'comparing' END WHEN 'click' THEN 'running_code' WHEN 'purchase' THEN 'verifying' ELSE 'reviewing' END AS phase FROM (SELECT *, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM events)")
def phases(spark, tables):
    tool = F.when(F.col("event_type") == "view", "search_documents").when(F.col("event_type") == "click", "run_python").when(F.col("event_type") == "purchase", "read_document_page").otherwise("list_documents")
    before = F.count_if(F.col("event_type") == "view").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return tables("events").select("event_id", K.tool_phase(tool, F.coalesce(before, F.lit(0))).alias("phase"))


@query("lifecycle_log_verdicts", f"SELECT user_id, verdict, count(*) AS n FROM (SELECT user_id, CASE WHEN f IS NULL THEN 'start' WHEN f = s THEN 'no_op' WHEN {ALLOWED} THEN 'allowed' ELSE 'invalid' END AS verdict FROM (SELECT user_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)) GROUP BY 1, 2")
def verdicts(spark, tables):
    return M.judge_log(tables("events"), "user_id", "event_id", "event_type", STATES).groupBy("user_id", "verdict").agg(F.count("*").alias("n"))


@query("lifecycle_replay", f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IS NOT NULL),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'signup' AS f, 0 AS applied, 0 AS ignored, 0 AS refused FROM e UNION ALL
 SELECT r.user_id, e.i, CASE WHEN f <> s AND ({ALLOWED}) THEN s ELSE f END, applied + (f <> s AND ({ALLOWED}))::INTEGER, ignored + (f = s)::INTEGER, refused + (f <> s AND NOT ({ALLOWED}))::INTEGER FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, arg_max(f, i) AS state, max(applied) AS applied, max(ignored) AS ignored, max(refused) AS refused FROM r GROUP BY user_id""")
def replayed(spark, tables):
    log = tables("events").filter("event_type IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("state"), F.lit(False).alias("force")))).alias("log"))
    return log.select("user_id", M.replay(F.col("log"), "signup", STATES).alias("r")).select("user_id", "r.*")


@query("lifecycle_events_since", "SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 200")
def since(spark, tables):
    return M.since(tables("events"), 5000, "event_id").select("event_id", "event_type")


@query("lifecycle_progress", "SELECT user_id, event_type, arg_max(props, event_id) AS status, arg_max(value, event_id) AS page FROM events GROUP BY 1, 2")
def progressed(spark, tables):
    return M.progress(tables("events").withColumnRenamed("props", "status").withColumnRenamed("value", "page"), ["user_id", "event_type"], "event_id")


@query("lifecycle_throttle", "SELECT event_id, in_window, in_window > 5 AS throttled FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS in_window FROM events)")
def throttle(spark, tables):
    return M.throttled(tables("events"), ["user_id"], seconds=36000).select("event_id", "in_window", "throttled")


@query("lifecycle_after_reset", "SELECT user_id, string_agg(event_id::VARCHAR, '' ORDER BY event_id) AS text FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS r FROM events) WHERE event_type = 'view' AND (r IS NULL OR event_id > r) GROUP BY user_id")
def reset(spark, tables):
    kind = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "view", "token")
    return M.after_reset(tables("events").select("user_id", "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("t")), "user_id", "event_id", "kind", "t")
