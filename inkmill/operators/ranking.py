"""Competing transcripts: batch status, rank, suspected summaries, and the page by engine grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.diffing import locked_spans
from inkmill.operators.selection import running_upper_median, upper_median_of


def batch_status(runs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One row a batch with its status, from its runs' statuses."""
    some = lambda *s: F.bool_or(F.coalesce(F.col("status").isin(*s), F.lit(False)))
    status = (
        F.when(some("queued", "running"), F.when(some("succeeded"), "partial").otherwise("running"))
        .when(some("succeeded"), "done")
        .when(F.bool_and(F.coalesce(F.col("status") == "cancelled", F.lit(False))), "cancelled")
        .otherwise("failed")
    )
    return runs.groupBy(batch).agg(status.alias("batch_status"))


def with_status(batches: DataFrame, runs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Batches without runs are queued."""
    return batches.join(batch_status(runs, batch), batch, "left").withColumn("batch_status", F.coalesce("batch_status", F.lit("queued")))


def target_state(status: Column) -> Column:
    return F.when(status == "done", "ocr_done").when(status == "partial", "ocr_partial").otherwise("ocr_failed")


def rank_key(confidence: Column, gibberish: Column, suspected: Column) -> Column:
    half = lambda c: F.coalesce(c, F.lit(0.5))
    return 0.35 * half(confidence) + 0.65 * (1.0 - half(gibberish)) - F.when(F.coalesce(suspected, F.lit(False)), 0.3).otherwise(0.0)


def upper_median(values: Column) -> Column:
    """The middle value, or the upper of the two."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_median_by(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """upper_median() of each key's values that are not null, without gathering them; those of hot keys are not even sorted."""
    return upper_median_of(rows, keys, value, name)


def flag_summaries(runs: DataFrame, batch: str = "batch_id", order: str = "finished_at", key: str = "run_id") -> DataFrame:
    """Marks runs with under 0.4 of the upper median of the runs that had finished before in the batch; raises their gibberish by 0.4, 1 at most."""
    known = running_upper_median(runs, batch, [order, key], "char_count", "__median")
    suspected = F.coalesce(F.col("char_count") < 0.4 * F.col("__median"), F.lit(False))
    raised = F.when(suspected, F.least(F.lit(1.0), F.coalesce("gibberish", F.lit(0.0)) + 0.4)).otherwise(F.col("gibberish"))
    return known.withColumn("suspected", suspected).withColumn("gibberish", raised).drop("__median")


def best_run(runs: DataFrame, batch: str = "batch_id", key: str = "run_id") -> DataFrame:
    """The run of least gibberish of each batch; runs without a score come last."""
    order = F.struct(F.col("gibberish").isNull(), "gibberish", key)
    rest = [c for c in runs.columns if c != batch]
    return runs.groupBy(batch).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(batch, "__r.*").select(runs.columns)


def compare(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page of a batch by every run that succeeded, best run first; a page that a run lacks has an empty text."""
    ok = runs.filter("status = 'succeeded'").withColumn("rank", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("rank_key"), "run_id")))
    numbers = pages.join(ok.select("batch_id", "run_id"), "run_id").select("batch_id", "page_number").distinct()
    grid = ok.join(numbers, "batch_id")
    text = F.coalesce("text", F.lit(""))
    return grid.join(pages.select("run_id", "page_number", "text"), ["run_id", "page_number"], "left").select("batch_id", "page_number", "rank", "run_id", text.alias("text"), F.length(text).alias("char_count"))


def compare_grid(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """compare() by page: batch_id, page_number, columns (rank, run_id, text, char_count) with the best run first, locked spans and agreement."""
    columns = F.array_sort(F.collect_list(F.struct("rank", "run_id", "text", "char_count")))
    grid = compare(runs, pages).groupBy("batch_id", "page_number").agg(columns.alias("columns"))  # a column for each engine
    found = grid.withColumn("found", locked_spans(F.transform("columns", lambda c: c["text"])))
    return found.select("batch_id", "page_number", "columns", "found.spans", "found.agreement")


def report_totals(reports: DataFrame, job: str = "job_id") -> DataFrame:
    """Totals of a job over its pages: pages, changes proposed, accepted and rejected, characters touched, pages to be reviewed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return reports.groupBy(job).agg(F.count("*").alias("pages"), *[total(c).alias(c) for c in ("proposed", "accepted", "rejected", "chars_touched")], F.count_if("needs_review").alias("needs_review"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Word boxes of level 5 to lines: text, bounds and mean confidence, confidences below 0 as 0, by hundred."""
    rows = words.filter("level = 5 AND trim(text) <> ''")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("block", "par", "line").agg(texts.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.avg(F.greatest(F.col("conf"), F.lit(0))) / 100).alias("confidence"))
