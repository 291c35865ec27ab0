"""Hosts: registrable domains under a table of public suffixes, and addresses that aren't public."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def registrable_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain) of distinct hosts. rules: (suffix, kind), kind of 'normal', 'wildcard' (of *.suffix) or 'exception'.

    An exception wins, else the longest rule that fits, else the last label is the suffix. Null for addresses, for hosts
    with empty labels and for suffixes themselves. Suffixes are found by a join on each tail of the host.
    """
    h = hosts.select(F.lower(F.regexp_replace(host, r"\.$", "")).alias("h"), F.col(host).alias("host")).distinct().withColumn("l", F.split("h", r"\."))
    n = F.size("l")
    tails = h.select("host", "l", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("l", i, n), "."))).alias("i", "tail"))
    hit = tails.join(rules, tails["tail"] == rules["suffix"]).select("host", "i", "kind", F.size("l").alias("n"))
    size = F.when(F.col("kind") == "exception", F.col("n") - F.col("i") - 1).when(F.col("kind") == "wildcard", F.when(F.col("i") > 0, F.col("n") - F.col("i") + 1)).otherwise(F.col("n") - F.col("i"))
    best = hit.groupBy("host").agg(F.max(F.when(F.col("kind") == "exception", size)).alias("e"), F.max(F.when(F.col("kind") != "exception", size)).alias("s"))
    k = F.coalesce("e", "s", F.lit(1))
    ok = (n > k) & ~F.exists("l", lambda x: x == "") & ~F.col("h").rlike(r"^\d+(\.\d+){3}$|^\[") & F.col("h").isNotNull()
    return h.join(best, "host", "left").select("host", F.when(ok, F.array_join(F.slice("l", n - k, k + 1), ".")).alias("domain"))


@F.pandas_udf(BooleanType())
def is_public_address(text: pd.Series) -> pd.Series:
    """Whether an address may be fetched from; null for what is no address."""

    def one(x):
        try:
            return ipaddress.ip_address(x).is_global if x else None
        except ValueError:
            return None

    return pd.Series([one(x) for x in text], dtype="object")
