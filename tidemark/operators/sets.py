"""Set and multiset operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each value that is in one more often than in the other, with the numbers removed and added. Nulls are equal."""
    keys = before.columns
    signed = before.withColumn("d", F.lit(-1)).unionByName(after.withColumn("d", F.lit(1)))
    net = signed.groupBy(*keys).agg(F.sum("d").alias("d")).where("d != 0")
    return net.select(*keys, F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("removed"), F.greatest(F.col("d"), F.lit(0)).cast("long").alias("added"))
