"""Rows picked per key, reconciliation without MERGE, rank helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, which should end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def first_n_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, numbered in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """``old`` with ``new`` rows put in by key: new columns win, unless ``keep`` holds of the old row
    (columns as ``o.<name>``). A full outer join, as parquet has no MERGE."""
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    left, right = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    both = left.alias("o").join(right.alias("n"), on, "full_outer")
    take_new = F.col("n.__new").isNotNull()
    if keep is not None:
        take_new = take_new & ~F.coalesce(keep & F.col("o.__old").isNotNull(), F.lit(False))
    pick = lambda c: F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return both.select(*(pick(c).alias(c) for c in old.columns))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those ``new`` rows whose key it hasn't."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The ``new`` rows that differ from the old row of their key, nulls being equal, or have none."""
    other = [c for c in new.columns if c not in keys]
    was = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in other), F.lit(True).alias("__had"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in other), F.lit(True))
    return new.join(was, keys, "left").where(F.col("__had").isNull() | ~same).select(new.columns)


def retained(df: DataFrame, time: str, now, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now``."""
    return df.where(F.col(time) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


STATUS_RANK = ("unknown", "green", "amber", "red")


def worst(status: Column) -> Column:
    """Aggregate: the worst of statuses; unknown without any."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_RANK)), status)
    return F.element_at(F.array(*map(F.lit, STATUS_RANK)), F.coalesce(F.max(rank), F.lit(1)).cast("int"))


def upper_middle(values: Column) -> Column:
    """The upper middle of an array's values; null if there are none."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")))
