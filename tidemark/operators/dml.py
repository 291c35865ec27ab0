"""Changes to tables as frames: the new state from the old one and the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(df: DataFrame, keys: list[str]) -> Column:
    """True where no part of the key is null: a null never conflicts."""
    out = F.lit(True)
    for k in keys:
        out = out & df[k].isNotNull()
    return out


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table and those new rows whose key neither it nor an earlier new row has."""
    first = new.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where((F.col("k_") == 1) | ~_key(new, keys)).drop("k_")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti").select(table.columns))


def insert_or_replace(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table without the rows that a new one replaces, and the last new row of each key."""
    last = new.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where((F.col("k_") == 1) | ~_key(new, keys)).drop("k_")
    return table.join(last.select(*keys), keys, "left_anti").select(table.columns).unionByName(last.select(table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Column], where: Column | None = None) -> DataFrame:
    """New rows are added; where the key exists, update's columns are set if where holds.

    Expressions see the old row under its names and the new one as excluded_<name>. new has one row per key.
    """
    n = new.select(*[F.col(c).alias(f"excluded_{c}") for c in new.columns])
    on = F.lit(True)
    for k in keys:
        on = on & (table[k] == n[f"excluded_{k}"])
    both = table.withColumn("old_", F.lit(True)).join(n, on, "full_outer")
    old, excluded = F.coalesce("old_", F.lit(False)), F.col(f"excluded_{keys[0]}").isNotNull()
    hit = old & excluded & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    return both.select(*[F.when(~old, F.col(f"excluded_{c}")).otherwise(F.when(hit, update[c]).otherwise(F.col(c)) if c in update else F.col(c)).alias(c) for c in table.columns])


def update(table: DataFrame, where: Column, new: dict[str, Column]) -> DataFrame:
    """All new values come from the old row; rows where the condition is null stay."""
    return table.select(*[F.when(where, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def unique_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.where(_key(table, keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def failed_checks(table: DataFrame, check: Column) -> DataFrame:
    """A check fails only where it is false; null passes."""
    return table.where(~F.coalesce(check, F.lit(True)))


def with_next_ids(table: DataFrame, new: DataFrame, id_col: str, order: str) -> DataFrame:
    """new rows with ids after the greatest in table, in order. Ranked in two levels: ranges, then rows within each."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top_"))
    cuts = new.agg(F.percentile_approx(order, [i / 64 for i in range(1, 64)]).alias("q")).first()["q"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    parts = new.withColumn("part_", part)
    sizes = parts.groupBy("part_").agg(F.count("*").alias("n_"))
    base = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    k = F.row_number().over(Window.partitionBy("part_").orderBy(order))
    return parts.withColumn("k_", k).join(base, "part_").crossJoin(F.broadcast(top)).withColumn(id_col, F.col("top_") + F.col("base_") + F.col("k_")).drop("part_", "k_", "base_", "top_")
