"""Loops over tables: all open turns (or records) advance together, a round at a time, and those that are done leave by an anti-join.

A round reads the open ones only and is written once to the shared folder, so plans do not grow with the rounds and a lost
executor costs one round at most. The number of rounds is bounded and small; what models answer comes in as tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.research import CONFIDENT, MOST_ATTEMPTS, MOST_STEPS
from inkmill.session import written


def research(steps: DataFrame, alternatives: DataFrame, search: Callable[[DataFrame], DataFrame], checks: DataFrame, attempts: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Research turns: steps are searched again, in other words, until all are answered, nothing is found at all, or attempts end.

    steps: turn_id, step, question, query. alternatives: turn_id, attempt (from 1), question, query; a blank one changes nothing.
    search: from (turn_id, step, query, attempt) to hits (turn_id, chunk_id and more). checks: turn_id, attempt (from 0), question,
    confidence, answer; they count for all steps of a turn, and only a higher confidence replaces an earlier one.
    Returns the steps (turn_id, step, question, query, confidence, answer, attempts, stopped) and the first hit of each turn and chunk.
    """
    now = steps.filter(F.col("step") < MOST_STEPS).select("turn_id", "step", "question", "query", F.lit(0.0).alias("confidence"), F.lit(None).cast(checks.schema["answer"].dataType).alias("answer"), F.lit(0).alias("attempts"), F.lit(False).alias("found"))
    open_, done, found = written(now), None, None
    for attempt in range(attempts):
        pending = open_.filter(F.col("confidence") < CONFIDENT)
        if attempt:
            other = alternatives.filter((F.col("attempt") == attempt) & (F.trim("query") != "")).select("turn_id", "question", F.trim("query").alias("other"))
            reworded = pending.join(other, ["turn_id", "question"], "left").select("turn_id", "step", F.coalesce("other", "query").alias("query"))
        else:
            reworded = pending.select("turn_id", "step", "query")
        asked = written(reworded)
        hits = written(search(asked.withColumn("attempt", F.lit(attempt))).withColumn("attempt", F.lit(attempt)))
        found = hits if found is None else found.unionByName(hits)
        with_hits = hits.select("turn_id").distinct().withColumn("hit", F.lit(True))
        judged = checks.filter((F.col("attempt") == attempt) & F.col("confidence").isNotNull()).groupBy("turn_id", "question").agg(F.max_by(F.struct("confidence", "answer"), "confidence").alias("new"))
        rows = open_.join(asked.withColumnRenamed("query", "asked"), ["turn_id", "step"], "left").join(with_hits, "turn_id", "left").join(judged, ["turn_id", "question"], "left")
        any_found = F.col("found") | F.coalesce("hit", F.lit(False))
        better = any_found & F.coalesce(F.col("new.confidence") > F.col("confidence"), F.lit(False))
        state = written(rows.select(
            "turn_id", "step", "question", F.coalesce("asked", "query").alias("query"), F.when(better, F.col("new.confidence")).otherwise(F.col("confidence")).alias("confidence"),
            F.when(better, F.col("new.answer")).otherwise(F.col("answer")).alias("answer"), F.lit(attempt + 1).alias("attempts"), any_found.alias("found"),
        ))
        turns = state.groupBy("turn_id").agg(F.min("confidence").alias("least"), F.bool_or("found").alias("any"))
        last = F.lit("attempts ended") if attempt == attempts - 1 else F.lit(None).cast("string")
        ends = turns.select("turn_id", F.when(~F.col("any"), "nothing found").when(F.col("least") >= CONFIDENT, "answered").otherwise(last).alias("stopped")).filter("stopped IS NOT NULL")
        ends = written(ends)
        closed = state.join(ends, "turn_id")
        done = closed if done is None else done.unionByName(closed)
        open_ = state.join(ends.select("turn_id"), "turn_id", "left_anti")
        if open_.isEmpty():
            break
    first = found.groupBy("turn_id", "chunk_id").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("turn_id", "chunk_id")]), "attempt").alias("r"))
    return done.drop("found"), first.select("turn_id", "chunk_id", "r.*")


def ladder(items: DataFrame, key: str, rungs: list[Callable[[DataFrame], DataFrame]], whole: int = 3, floor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tries rung after rung on the records that have no valid result yet.

    A rung maps open records, with the last rung's `error`, to (key, valid, record, error), a row each. Results of rungs behind the
    first `whole` are partial. What no rung makes valid gets floor(open): key, record. Returns key, record, attempts,
    is_partial, quality_flags.
    """
    open_, out = items.withColumn("error", F.lit(None).cast("string")), None
    for n, rung in enumerate(rungs, 1):
        tried = written(rung(open_).select(key, "valid", "record", "error"))
        flags = F.array(F.lit("metadata_degraded")) if n > whole else F.array().cast("array<string>")
        won = tried.filter("valid").select(key, "record", F.lit(n).alias("attempts"), F.lit(n > whole).alias("is_partial"), flags.alias("quality_flags"))
        out = won if out is None else out.unionByName(won)
        errors = tried.filter(~F.coalesce(F.col("valid"), F.lit(False))).select(key, F.col("error").alias("__error"))
        open_ = written(open_.join(tried.filter("valid").select(key), key, "left_anti").join(errors, key, "left").withColumn("error", F.col("__error")).drop("__error"))
        if open_.isEmpty():
            return out
    if floor is None:
        return out
    flags = F.array(F.lit("metadata_degraded"), F.lit("metadata_unavailable"))
    return out.unionByName(floor(open_).select(key, "record", F.lit(len(rungs)).alias("attempts"), F.lit(True).alias("is_partial"), flags.alias("quality_flags")))
