"""The data side of research turns: attempts, sources and answers as tables; models are asked elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIDENT, MOST_STEPS, MOST_ATTEMPTS, MOST_PASSAGES = 0.6, 5, 3, 14


def sources(hits: DataFrame) -> DataFrame:
    """Each chunk as it was found first in its turn (turn_id, chunk_id, arrival, score ...)."""
    rest = [c for c in hits.columns if c not in ("turn_id", "chunk_id")]
    first = hits.groupBy("turn_id", "chunk_id").agg(F.min_by(F.struct(*rest), "arrival").alias("r"))
    return first.select("turn_id", "chunk_id", "r.*")


def passages(found: DataFrame) -> DataFrame:
    """The best passages of each turn by score; ties to the earlier."""
    w = Window.partitionBy("turn_id").orderBy(F.desc("score"), "arrival")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST_PASSAGES).drop("n")


def answers(steps: DataFrame, checks: DataFrame) -> DataFrame:
    """Each step with the answer of its highest confidence over attempts; only a higher one replaces an earlier."""
    best = checks.filter((F.col("confidence") > 0) & (F.col("attempt") < MOST_ATTEMPTS)).groupBy("turn_id", "question").agg(F.max_by("answer", F.struct(F.col("confidence"), -F.col("attempt"))).alias("answer"), F.max("confidence").alias("confidence"))
    joined = steps.filter(F.col("step") < MOST_STEPS).join(best, ["turn_id", "question"], "left")
    return joined.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("answered", F.col("confidence") >= CONFIDENT)


def first_valid(attempts: DataFrame, key: str, floor: dict) -> DataFrame:
    """The first attempt that was valid; where none was, the floor record, marked as degraded."""
    won = attempts.filter("valid").groupBy(key).agg(F.min_by(F.struct(*floor), "attempt").alias("r"))
    rows = attempts.select(key).distinct().join(won, key, "left")
    return rows.select(key, *[F.when(F.col("r").isNull(), F.lit(v)).otherwise(F.col(f"r.{c}")).alias(c) for c, v in floor.items()], F.col("r").isNull().alias("degraded"))


def fan_out(batches: DataFrame, engines: str = "engines") -> DataFrame:
    """One queued run for each engine of a batch."""
    return batches.select("*", F.explode(engines).alias("engine")).drop(engines).withColumn("status", F.lit("queued"))


def estimated_cost(runs: DataFrame, engines: DataFrame) -> DataFrame:
    """Seconds that each batch is expected to take: pages by the engines' seconds a page."""
    return runs.join(engines, "engine").groupBy("batch_id").agg(F.sum(F.col("pages") * F.col("seconds")).alias("seconds"))


def seen_digits(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Digits that any transcript of a page holds."""
    own = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Nd}"), 0))
    return texts.select(key, F.explode(own).alias("digit")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("digit")).alias("digits"))
