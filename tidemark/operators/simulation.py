"""Seeded simulation: each replicate has its own named random numbers, so any of them can be run anywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


class Stream:
    """SplitMix64, begun from the digest of (seed, name, replicate)."""

    def __init__(self, seed: int, name: str, replicate: int):
        self.state = int.from_bytes(hashlib.sha256(f"{seed}:{name}:{replicate}".encode()).digest()[:8], "big")

    def uniform(self) -> float:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return ((z ^ (z >> 31)) >> 11) / 2**53


def replicate(seed: int, k: int, buyers: int, steps: int, price: int, value_lo: int, value_hi: int, awareness: float) -> tuple[int, int, float]:
    """(units, revenue, last step with a sale): each buyer once, when aware and if the price is under their value."""
    reach, worth = Stream(seed, "awareness", k), Stream(seed, "value", k)
    limits = [value_lo + worth.uniform() * (value_hi - value_lo) for _ in range(buyers)]
    units, last, waiting = 0, -1, list(range(buyers))
    for step in range(steps):
        still = []
        for b in waiting:
            if reach.uniform() >= awareness:
                still.append(b)
            elif limits[b] >= price:
                units, last = units + 1, step
        waiting = still
    return units, units * price, float(last)


def run(spark: SparkSession, seed: int, replicates: int, prices: list[int], buyers: int = 200, steps: int = 30) -> DataFrame:
    """Metrics per (price, replicate). All prices see the same random numbers, so their differences are paired."""

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(int(p), int(k), *replicate(seed, int(k), buyers, steps, int(p), 500, 1500, 0.1)) for p, k in zip(f["price"], f["replicate"], strict=True)]
            yield pd.DataFrame(rows, columns=["price", "replicate", "units", "revenue", "last_step"])

    grid = spark.range(replicates).select(F.explode(F.array(*[F.lit(p) for p in prices])).alias("price"), F.col("id").alias("replicate"))
    return grid.repartition(8).mapInPandas(some, "price int, replicate long, units long, revenue long, last_step double")


def dispersion(runs: DataFrame, by: str, metric: str) -> DataFrame:
    q = F.percentile(metric, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")
    g = runs.groupBy(by).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), q, F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    return g.select(by, "n", "mean", "sd", *[F.col("q")[i].alias(c) for i, c in enumerate(("p10", "median", "p90"))], "lo", "hi")
