"""Text functions for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkmill.functions.text import FOLD_FROM, FOLD_TO, MARKS


def register(spark: SparkSession) -> None:
    """Temporary SQL function ar_normalize(text): inlined by the optimizer, so it stays inside generated code."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ar_normalize(t STRING) RETURNS STRING DETERMINISTIC RETURN lower(translate(regexp_replace(t, '{MARKS}', ''), '{FOLD_FROM}', '{FOLD_TO}'))")
