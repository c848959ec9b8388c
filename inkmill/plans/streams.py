"""Streaming queries over the supplied events, drained to the end; SQL computes the same from the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.plans.base import ORACLE_SQL, QUERIES
from inkmill.plans.conversation import ALLOWED, STATES
from inkmill.session import shared_folder, table
from inkmill.streaming import lifecycle as L
from inkmill.streaming import stateful as S


def drained(build, mode: str):
    def run(spark, sf_dir):
        # The file source takes a folder or a pattern; the schema is that of the table.
        events = L.read_events(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
        return L.drain(build(events), mode, shared_folder(spark))

    return run


QUERIES["stream_transitions"] = drained(lambda e: L.apply_transitions(e, "user_id", "event_type", "event_id", "signup", STATES).select("event_id", "verdict"), "append")
ORACLE_SQL["stream_transitions"] = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'signup' AS f, NULL::BIGINT AS event_id, '' AS verdict FROM e UNION ALL
 SELECT r.user_id, e.i, CASE WHEN f <> s AND ({ALLOWED}) THEN s ELSE f END, e.event_id, CASE WHEN f = s THEN 'no_op' WHEN {ALLOWED} THEN 'allowed' ELSE 'invalid' END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, verdict FROM r WHERE i > 0"""

QUERIES["stream_windowed_counts"] = drained(lambda e: L.windowed_counts(e, ["event_type"]).select(F.unix_timestamp("start").alias("start"), "event_type", "n"), "complete")
ORACLE_SQL["stream_windowed_counts"] = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"

QUERIES["stream_progress"] = drained(lambda e: L.progress(e, ["user_id", "event_type"], "event_id", "value"), "complete")
ORACLE_SQL["stream_progress"] = "SELECT user_id, event_type, arg_max_null(value, event_id) AS value FROM events GROUP BY 1, 2"


def last_of(spark, found, key: str):
    """The last row of each key that a drained stream gave."""
    return found.groupBy(key).agg(F.max_by(F.struct(*[c for c in found.columns if c != key]), "seq").alias("r")).select(key, "r.*")


def stateful(build, last: bool = True):
    def run(spark, sf_dir):
        rows = drained(build, "append")(spark, sf_dir)
        return last_of(spark, rows, "user_id") if last else rows

    return run


def requests(e):
    none = F.lit(None).cast("string")
    return e.filter("event_type IS NOT NULL").select("user_id", F.col("event_id").alias("seq"), F.lit("transition").alias("kind"), F.col("event_type").alias("name"), none.alias("status"), (F.col("event_id") % 11 == 0).alias("force"))


QUERIES["stream_forced_lifecycle"] = lambda spark, sf_dir: stateful(lambda e: S.lifecycle(requests(e), "user_id", "signup", STATES))(spark, sf_dir).select("user_id", "state", "applied", "ignored", "refused")
MOVES = f"f <> s AND (({ALLOWED}) OR force)"
ORACLE_SQL["stream_forced_lifecycle"] = f"""WITH RECURSIVE e AS (SELECT user_id, event_id % 11 = 0 AS force, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IS NOT NULL),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'signup' AS f, 0::BIGINT AS applied, 0::BIGINT AS ignored, 0::BIGINT AS refused FROM e UNION ALL
 SELECT r.user_id, e.i, CASE WHEN {MOVES} THEN s ELSE f END, applied + ({MOVES})::BIGINT, ignored + (f = s)::BIGINT, refused + (f <> s AND NOT ({MOVES}))::BIGINT FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, arg_max(f, i) AS state, max(applied) AS applied, max(ignored) AS ignored, max(refused) AS refused FROM r GROUP BY user_id"""


def runs(e):
    """Views ask for another round; other events are the progress of three runs of a document."""
    status = F.create_map(*map(F.lit, ["purchase", "succeeded", "error", "failed", "click", "running", "signup", "cancelled"]))[F.col("event_type")]
    view, run = F.col("event_type") == "view", F.concat(F.lit("run"), F.col("event_id") % 3)
    return e.filter("event_type IS NOT NULL").select("user_id", F.col("event_id").alias("seq"), F.when(view, "transition").otherwise("run").alias("kind"), F.when(view, "ocr_running").otherwise(run).alias("name"), status.alias("status"), F.lit(False).alias("force"))


QUERIES["stream_batch_progress"] = lambda spark, sf_dir: stateful(lambda e: S.lifecycle(runs(e), "user_id", "ocr_running"), last=False)(spark, sf_dir).select(F.col("seq").alias("event_id"), "state", "batch_status")
RUNS = "list_filter([r0, r1, r2], lambda x: x IS NOT NULL)"
BATCH = f"CASE WHEN list_contains({RUNS}, 'running') THEN CASE WHEN list_contains({RUNS}, 'succeeded') THEN 'partial' ELSE 'running' END WHEN list_contains({RUNS}, 'succeeded') THEN 'done' WHEN len(list_filter({RUNS}, lambda x: x <> 'cancelled')) = 0 THEN 'cancelled' ELSE 'failed' END"
ORACLE_SQL["stream_batch_progress"] = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS t, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'cancelled' END AS st, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IS NOT NULL),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 'ocr_running' AS f, NULL::VARCHAR AS b, NULL::VARCHAR AS r0, NULL::VARCHAR AS r1, NULL::VARCHAR AS r2 FROM e UNION ALL
 SELECT user_id, i, event_id, CASE WHEN t = 'view' THEN CASE WHEN f IN ('ocr_partial', 'ocr_done', 'ocr_failed') THEN 'ocr_running' ELSE f END
   WHEN f = 'ocr_running' AND b = 'partial' THEN 'ocr_partial' WHEN f IN ('ocr_running', 'ocr_partial') AND b = 'done' THEN 'ocr_done' WHEN f IN ('ocr_running', 'ocr_partial') AND b IN ('failed', 'cancelled') THEN 'ocr_failed' ELSE f END, b, r0, r1, r2
 FROM (SELECT *, CASE WHEN t <> 'view' THEN {BATCH} END AS b FROM (SELECT e.user_id, e.i, e.event_id, e.t, r.f, CASE WHEN t <> 'view' AND e.event_id % 3 = 0 THEN st ELSE r0 END AS r0, CASE WHEN t <> 'view' AND e.event_id % 3 = 1 THEN st ELSE r1 END AS r1, CASE WHEN t <> 'view' AND e.event_id % 3 = 2 THEN st ELSE r2 END AS r2
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT event_id, f AS state, b AS batch_status FROM r WHERE i > 0"""

QUERIES["stream_throttle"] = lambda spark, sf_dir: stateful(lambda e: S.throttled(e.select("user_id", F.col("event_id").alias("seq"), F.col("ts").cast("double").alias("at")), "user_id", seconds=36000), last=False)(spark, sf_dir).select(F.col("seq").alias("event_id"), "in_window", "throttled")
ORACLE_SQL["stream_throttle"] = ORACLE_SQL["lifecycle_throttle"]


def tokens(e):
    kind = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "view", "token")
    return e.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("text"))


QUERIES["stream_after_reset"] = lambda spark, sf_dir: stateful(lambda e: S.answers(tokens(e), "user_id", each_batch=True))(spark, sf_dir).filter("text <> ''").select("user_id", "text")
ORACLE_SQL["stream_after_reset"] = ORACLE_SQL["lifecycle_after_reset"]


def handover(spark, sf_dir):
    """A reader of one user's events connects when half of all events are there; the others arrive before it reads on."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), shared_folder(spark)
    last, user = events.agg(F.max("event_id"), F.min("user_id")).first()
    events.filter(F.col("event_id") <= last // 2).write.parquet(f"{folder}/log")
    c = S.connect(spark, f"{folder}/log", events.schema, "user_id", user, "event_id", "event_type", last_seen=last // 10)
    first = spark.createDataFrame([("snapshot", c.snapshot["last_seq"], c.snapshot["status"])], "kind string, event_id long, event_type string")
    replay = c.replay.select(F.lit("replay").alias("kind"), "event_id", "event_type").collect()  # REPLAY_MOST rows at most, fixed before more arrive
    events.filter(F.col("event_id") > last // 2).write.mode("append").parquet(f"{folder}/log")
    tail = L.drain(c.tail.select("event_id", "event_type"), "append", f"{folder}/tail")
    return first.unionByName(spark.createDataFrame(replay, first.schema)).unionByName(tail.select(F.lit("tail").alias("kind"), "event_id", "event_type"))


QUERIES["stream_handover"] = handover
ORACLE_SQL["stream_handover"] = """WITH e AS (SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events)), c AS (SELECT max(event_id) // 2 AS half, max(event_id) // 10 AS seen FROM events),
s AS (SELECT max(event_id) AS last, arg_max(event_type, event_id) AS status FROM e, c WHERE event_id <= half), m AS (SELECT e.* FROM e, c, s WHERE event_id > seen AND event_id <= last ORDER BY event_id LIMIT 200),
h AS (SELECT CASE WHEN count(*) = 200 THEN max(event_id) ELSE (SELECT last FROM s) END AS h FROM m)
SELECT 'snapshot' AS kind, last AS event_id, status AS event_type FROM s UNION ALL SELECT 'replay', event_id, event_type FROM m UNION ALL SELECT 'tail', event_id, event_type FROM e, h WHERE event_id > h"""
