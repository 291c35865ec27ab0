"""Packed series, exact JSON and verified captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: minutes of packed series count from 2011-01-01, in seconds.
EPOCH = 1_293_840_000


def packed_series(df: DataFrame, key: list[str], packed: str, stride: int = 2) -> DataFrame:
    """(key, ts, value) of arrays [minute, value, ...]; a negative value is null."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.size(packed) / stride).cast("int") - 1)).alias("i")
    rows = df.where(F.size(packed) >= stride).select(*key, F.col(packed).alias("p"), at)
    minute, value = F.get("p", F.col("i") * stride), F.get("p", F.col("i") * stride + 1)
    return rows.select(*key, (minute * 60 + EPOCH).alias("ts"), F.when(value >= 0, value).alias("value"))


def verified(captures: DataFrame, content: str, digest: str) -> DataFrame:
    """The captures whose bytes have the digest that was recorded for them."""
    return captures.where(F.sha2(F.col(content).cast("binary"), 256) == F.lower(digest))


def export_chain(records: Column) -> Column:
    """A hash chain over sorted records: the manifest of an export."""
    return F.aggregate(F.array_sort(records), F.sha2(F.lit(""), 256), lambda h, r: F.sha2(F.concat_ws(":", h, F.sha2(r, 256)), 256))
