"""A document's life: allowed transitions, event logs, progress, and rates, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.relational import next_numbers

#: From each state the states that may follow (fixed values).
TRANSITIONS = {
    "uploaded": ["preprocessing", "failed"],
    "preprocessing": ["preprocessed", "failed"],
    "preprocessed": ["ocr_running", "text_finalized", "failed"],
    "ocr_running": ["ocr_partial", "ocr_done", "ocr_failed"],
    "ocr_partial": ["ocr_running", "ocr_done", "ocr_failed"],
    "ocr_done": ["ocr_running", "text_finalized"],
    "ocr_failed": ["ocr_running", "text_finalized", "failed"],
    "text_finalized": ["enriching", "ocr_running", "text_finalized"],
    "enriching": ["enriched", "text_finalized"],
    "enriched": ["indexing", "text_finalized", "enriching"],
    "indexing": ["indexed", "enriched"],
    "indexed": ["ready"],
    "ready": ["ocr_running", "text_finalized", "enriching", "indexing"],
    "failed": ["uploaded", "preprocessing"],
}


def allowed(current: Column, new: Column, transitions: dict[str, list[str]] = TRANSITIONS) -> Column:
    chain = F.lit(False)
    for state, following in transitions.items():
        chain = F.when(current == state, new.isin(following)).otherwise(chain)
    return chain


def judge_log(events: DataFrame, key: str, seq: str, state: str, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Each event with the state before it in the log, and whether it is a no-op, allowed or invalid; the first is the start."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(seq))
    verdict = F.when(before.isNull(), "start").when(before == F.col(state), "no_op").when(allowed(before, F.col(state), transitions), "allowed").otherwise("invalid")
    return events.withColumn("from_state", before).withColumn("verdict", verdict)


def replay(requests: Column, start: str, transitions: dict[str, list[str]] = TRANSITIONS) -> Column:
    """Applies requested states (state, force) in order: the final state and the counts of applied, ignored and refused ones."""

    def step(s: Column, r: Column) -> Column:
        same = s["state"] == r["state"]
        ok = ~same & (r["force"] | allowed(s["state"], r["state"], transitions))
        one = lambda c: c.cast("int")
        return F.struct(F.when(ok, r["state"]).otherwise(s["state"]).alias("state"), (s["applied"] + one(ok)).alias("applied"), (s["ignored"] + one(same)).alias("ignored"), (s["refused"] + one(~ok & ~same)).alias("refused"))

    zero = lambda n: F.lit(0).alias(n)
    return F.aggregate(requests, F.struct(F.lit(start).alias("state"), zero("applied"), zero("ignored"), zero("refused")), step)


def retry_state(stage: Column) -> Column:
    """The state that a stage to be run again starts from; null for unknown stages."""
    return F.when(stage == "preprocess", "uploaded").when(stage.isin("enrich", "index"), stage)


def adopt_runs(picks: DataFrame, runs: DataFrame, revisions: DataFrame) -> DataFrame:
    """New revisions from picked runs: document_id, revision_no (the next), text, source, origin_run, note.

    picks: document_id, run_id. Only runs of that document that succeeded can be adopted; others give no row.
    """
    fit = picks.join(runs.filter("status = 'succeeded'"), ["document_id", "run_id"]).select("document_id", "text", F.col("run_id").alias("origin_run"), F.concat(F.lit("selected "), "engine").alias("note"))
    numbered = next_numbers(revisions.select("document_id", "revision_no"), fit, "document_id", "revision_no", "origin_run")
    return numbered.select("document_id", "revision_no", "text", F.lit("ocr_pick").alias("source"), "origin_run", "note")


def finalize(revisions: DataFrame, chosen: DataFrame) -> DataFrame:
    """revisions with is_final set on one of each document in chosen and cleared on its others.

    chosen: document_id, revision_no (null or 0: the current one) and current_no. Where the document has no such revision nothing changes.
    """
    wanted = chosen.select("document_id", F.coalesce(F.nullif("revision_no", F.lit(0)), "current_no").alias("wanted"))
    there = wanted.join(revisions.select("document_id", F.col("revision_no").alias("wanted")), ["document_id", "wanted"], "left_semi")
    joined = revisions.join(there, "document_id", "left")
    return joined.withColumn("is_final", F.when(F.col("wanted").isNull(), F.col("is_final")).otherwise(F.col("revision_no") == F.col("wanted"))).drop("wanted")


def since(events: DataFrame, last: int, seq: str = "seq", limit: int = 200) -> DataFrame:
    """Events after the last one seen, in order."""
    return events.filter(F.col(seq) > last).orderBy(seq).limit(limit)


def progress(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last status and page of each engine."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("status", "page"), seq).alias("last")).select(*keys, "last.*")


def throttled(attempts: DataFrame, keys: list[str], ts: str = "ts", most: int = 5, seconds: int = 60) -> DataFrame:
    """Marks attempts beyond `most` within the last `seconds` (the attempt itself included)."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return attempts.withColumn("in_window", F.count("*").over(w)).withColumn("throttled", F.col("in_window") > most)


def after_reset(events: DataFrame, key: str, seq: str, kind: str, text: str) -> DataFrame:
    """Text of the tokens after each key's last reset, in order."""
    last = F.max(F.when(F.col(kind) == "reset", F.col(seq))).over(Window.partitionBy(key))
    kept = events.withColumn("last_reset", last).filter((F.col(kind) == "token") & (F.col("last_reset").isNull() | (F.col(seq) > F.col("last_reset"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "").alias("text"))
