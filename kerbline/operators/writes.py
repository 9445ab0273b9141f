"""Writes as rewrites: each takes the table and the change and returns the table as it then is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def ledger_append(ledger: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New entries once each, unless the key is there already."""
    fresh = new.dropDuplicates(list(key)).join(ledger.select(*key), list(key), "left_anti")
    return ledger.unionByName(fresh)


def patched(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of the patch overwrite where they are not null."""
    columns = [c for c in patch.columns if c != key]
    p = patch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(p, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def counted_up(table: DataFrame, calls: DataFrame, key: str, counter: str) -> DataFrame:
    n = calls.groupBy(key).agg(F.count("*").alias("_n"))
    return table.join(n, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def arrays_merged(table: DataFrame, change: DataFrame, key: str, column: str) -> DataFrame:
    """Insert or append: arrays of both sides in a row, either may be missing."""
    none = F.array().cast(dict(table.dtypes)[column])
    both = table.select(key, F.col(column).alias("a")).join(change.select(key, F.col(column).alias("b")), key, "full")
    return both.select(key, F.concat(F.coalesce("a", none), F.coalesce("b", none)).alias(column))


def marked(table: DataFrame, column: str, value: object, where: Column) -> DataFrame:
    return table.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
