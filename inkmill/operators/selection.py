"""Exact order statistics of hot keys by counting, and running medians in sorted order."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.session import written

BINS = 4096
HOT_SHARE = 1000  #: keys of over a 1,000th of all rows are counted: under 1,000 keys


def kth_by(rows: DataFrame, keys: list[str], value: str, place: Column, name: str = "kth", hot: int | None = None) -> DataFrame:
    """Of each key the value at a place (from 0, an expression of n, the key's number of values) in ascending order; nulls do not count.

    Few keys hold many rows: their values are never sorted. Each pass counts them in BINS bins between the least and the
    greatest value that are left and keeps the bin of the place, until that holds one value only; three passes tell 2^36
    steps apart, and each bin's own least and greatest values make every pass end closer. The rest is ranked by a window. hot: rows of a
    key that is counted, by default over a HOT_SHARE-th of all.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    limit = hot if hot is not None else max(1000, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    w = Window.partitionBy(*keys)
    few = sizes.filter(F.col("n") <= limit).select(*keys, "n")
    ranked = rows.join(few, keys).withColumn("__at", F.row_number().over(w.orderBy("__v")) - 1).filter(F.col("__at") == place)
    out = ranked.select(*keys, F.col("__v").alias(name))
    at = sizes.filter(F.col("n") > limit).select(*keys, "n", "lo", "hi", place.cast("long").alias("at"))
    while True:
        at = written(at)
        out = out.unionByName(at.filter("lo = hi").select(*keys, F.col("lo").alias(name)))
        at = at.filter("lo < hi")
        if at.isEmpty():
            return out
        # Bounded: under HOT_SHARE keys. A hot key's rows stay where they are and give a row a bin and task.
        share = (F.col("__v").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
        binned = rows.join(F.broadcast(at), keys).filter(F.col("__v").between(F.col("lo"), F.col("hi")))
        # The greatest value has the last bin for itself and the likes of it, so a pass always parts it from the least.
        bin_ = F.when(F.col("__v") == F.col("hi"), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = binned.groupBy(*keys, "at", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # at most BINS + 1 rows a key
        placed = counts.withColumn("before", F.coalesce(before, F.lit(0)))
        at = placed.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("c"))).select(*keys, F.col("c").alias("n"), "lo", "hi", (F.col("at") - F.col("before")).alias("at"))


def upper_median_of(rows: DataFrame, keys: list[str], value: str, name: str = "median", hot: int | None = None) -> DataFrame:
    """The middle value of each key, or the upper of the two."""
    return kth_by(rows, keys, value, F.floor(F.col("n") / 2), name, hot)


def running_upper_median(rows: DataFrame, key: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """rows with the upper median of the positive values of earlier rows of their key, null where there are none.

    Rows come sorted by key and order; a task keeps the sorted values of the key that it is at (eight bytes each), not of rows.
    """
    columns = [f for f in rows.schema if f.name != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + f", `{name}` double"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), []
        for frame in frames:
            found = []
            for k, v in zip(frame[key], frame[value]):
                if k != now:
                    now, held = k, []
                found.append(held[len(held) // 2] if held else None)
                if v is not None and v > 0:
                    bisect.insort(held, float(v))
            yield frame.assign(**{name: pd.Series(found, index=frame.index, dtype="float64")})

    return rows.select([f.name for f in columns]).repartition(key).sortWithinPartitions(key, *order).mapInPandas(task, schema)
