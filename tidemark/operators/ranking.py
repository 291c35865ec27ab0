"""Latest, top and evicted rows, and exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import store


def latest(df: DataFrame, keys: list[str], newest: list[str], tie: str) -> DataFrame:
    """One row per key: the greatest in newest, of equal ones the smallest tie. Aggregated, so hot keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in newest], (-F.col(tie)).alias("tie"))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows of each key. Spark limits each partition's group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def running_total(df: DataFrame, value: str, key: str, name: str, buckets: int = 256, ties: tuple[str, ...] = ()) -> DataFrame:
    """A running sum over the whole table by descending numeric key, in two levels.

    Rows are dealt into stretches of the key at its quantiles; only one number per stretch is summed in one place.
    Rows of equal keys come in the order of ties. Null keys come last.
    """
    cuts = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)]).alias("q")).first()["q"] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c > F.col(key))) if cuts else F.lit(0)
    parts = df.withColumn("part_", F.when(F.col(key).isNull(), buckets).otherwise(at))
    sums = parts.groupBy("part_").agg(F.sum(value).alias("s"))
    before = sums.select("part_", F.coalesce(F.sum("s").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum(value).over(Window.partitionBy("part_").orderBy(F.desc(key), *ties).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn(name, inner).join(before, "part_").withColumn(name, F.col(name) + F.col("base")).drop("part_", "base")


def evicted(df: DataFrame, size: str, key: str, limit: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows that don't fit in limit when those of the greatest key are kept first, and of equal ones those of the least ties."""
    return running_total(df, size, key, "run_", ties=ties).where(F.col("run_") > limit).drop("run_")


def order_statistics(df: DataFrame, key: list[str], value: str, wanted: DataFrame, bins: int = 1024) -> DataFrame:
    """(key, rank, value): the value of each wanted (key, rank), counted from 0 in order of size; null values don't count.

    Selection by histograms: the range that holds a rank is parted in bins, counted, and narrowed to the bin's own least
    and greatest value, until these are the same. A pass aggregates `bins` counts for each wanted rank, whatever the number
    of rows, and a few passes do. Ranks beyond the number of values are left out; infinite values and NaN are refused.
    """
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("v_"))
    ends = rows.groupBy(*key).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.count("*").alias("n_"))
    open_ = store(wanted.select(*key, "rank").distinct().join(ends, key).where("rank >= 0 AND rank < n_").select(*key, "rank", F.col("rank").alias("left_"), "lo_", "hi_"), "ranks")
    if not open_.where(F.isnan("lo_") | F.isnan("hi_") | (F.abs("lo_") == float("inf")) | (F.abs("hi_") == float("inf"))).isEmpty():
        raise ValueError("the values must be finite")
    found, of = [], [*key, "rank"]
    while True:
        found.append(open_.where("lo_ = hi_").select(*of, F.col("lo_").alias("value")))
        open_ = open_.where("lo_ < hi_")
        if open_.isEmpty():
            break
        within = rows.join(open_, key).where("v_ BETWEEN lo_ AND hi_")
        # Halves, so that the width of a range is never infinite.
        share = (F.col("v_") / 2 - F.col("lo_") / 2) / (F.col("hi_") / 2 - F.col("lo_") / 2)
        at = F.when(F.col("v_") == F.col("hi_"), bins).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = within.groupBy(*of, "left_", at.alias("bin_")).agg(F.count("*").alias("c_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
        before = F.coalesce(F.sum("c_").over(Window.partitionBy(*of).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("before_", before).where("before_ <= left_ AND left_ < before_ + c_")
        open_ = store(placed.select(*of, (F.col("left_") - F.col("before_")).alias("left_"), "lo_", "hi_"), "ranks")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def quantiles(df: DataFrame, key: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles by key, interpolated between neighbours, in columns named as in qs; keys without a value are left out."""
    n = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count("*").alias("n_"))
    place = lambda q: (F.col("n_") - 1) * F.lit(float(q))
    ranks = F.array(*[r for q in qs.values() for r in (F.floor(place(q)), F.ceil(place(q)))])
    found = order_statistics(df, key, value, n.select(*key, F.explode(ranks).alias("rank")))
    values = n.join(found, key).groupBy(*key, "n_").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m_"))
    out = []
    for name, q in qs.items():
        lo, hi = F.element_at("m_", F.floor(place(q))), F.element_at("m_", F.ceil(place(q)))
        out.append((lo + (hi - lo) * (place(q) - F.floor(place(q)))).alias(name))
    return values.select(*key, *out)
