"""Writing tables without a store that can update in place: results are new tables, or whole partitions replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's values where new has the key and a value, and new's further rows."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in rest])


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of several such rows one that comes first by all columns."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("r")).select(*keys, "r.*")
    return old.unionByName(first.select(old.columns).join(old.select(*keys), keys, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in new are replaced by new's."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(old.columns))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition holds; a null condition does not hold."""
    test = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def erase(df: DataFrame, gone: DataFrame, key: str, by: str) -> DataFrame:
    """Rows whose key is not among those to be erased."""
    return df.join(gone.select(F.col(by).alias(key)).distinct(), key, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
