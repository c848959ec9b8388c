"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.core import let
from inkmill.session import shared_folder as shared_dir

__all__ = ["BROADCAST_ROWS", "connected", "discard", "let", "materialize", "partitions", "release", "shared_dir", "sorted_runs", "split_join"]

BROADCAST_ROWS = 2_000_000  #: a side of two longs a row is broadcast up to this many rows (some 32 MB)


def materialize(df: DataFrame, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder, in folders by a column if one is named, and reads it back.

    This cuts the lineage: a lost executor costs a re-read of the table, not of what made it.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Removes what materialize() wrote, or a part of it such as kind=left, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{df._shared_path}/{part}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark) -> None:
    """Lets Spark remove the shuffle files of finished plans now: it does so when the driver's heap is next collected."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a stream sorted by keys into tables that hold whole groups: a group is never divided."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.num_rows - 1
        same = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            same &= column == column[last]
        cut = int(np.argmax(same)) if same[0] or same.any() else last
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def split_join(left: DataFrame, right: DataFrame, key: str, weight: str, least: int = 1000) -> DataFrame:
    """left inner-joined to right, which has one row a key and, as weight, how many rows of left have it.

    Keys of many rows are broadcast, so that no task gets all of their rows: keys of over `least` rows
    and over a 100,000th of all, which bounds what is broadcast to 100,000 rows. The rest is shuffled.
    """
    most = max(least, (right.agg(F.sum(weight)).first()[0] or 0) // 100_000)
    hot, rest = F.broadcast(right.filter(F.col(weight) > most)), right.filter(F.col(weight) <= most)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), both of one orderable type: returns (node, root).

    root is the least node of the component. Only DataFrame operations: large-star and small-star
    rounds (Kiveris et al., 2014), each written to the shared folder, until a round changes nothing.
    A hub's neighbours are never gathered into one row; its minimum is pre-aggregated, and the join
    that hands it out is one whose hot keys adaptive execution may split. Rows with a null end or
    with u = v link nothing. An empty input gives an empty result.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Some hubs have many rows: minima of few edges are broadcast, so that no task gets a hub's rows alone.
        joined = e.join(F.broadcast(least) if 2 * n <= BROADCAST_ROWS else least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = least.filter("u > m").select("u", F.col("m").alias("v"))
        return joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        new = materialize(star(star(now, True, seen[0]), False, seen[0]))
        discard(now)
        now, before, seen = new, seen, mark(new)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
