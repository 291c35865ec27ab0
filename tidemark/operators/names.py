"""Matching names to known ones: exact after normalising, else by MinHash bands and exact Jaccard of character 3-grams."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark.functions.text import entropy, grams, jaccard, normal_exact, normal_fuzzy

# Fixed values.
SEEDS, BAND, ACCEPT, LEAST_ENTROPY = 32, 4, 0.9, 1.5


@F.pandas_udf(ArrayType(LongType()))
def signature(shingles: pd.Series) -> pd.Series:
    """Minima of BLAKE2b-64 over '{seed}:{shingle}', one for each seed; empty for no shingles."""

    def one(s):
        if s is None or not len(s):
            return []
        return [min(int.from_bytes(hashlib.blake2b(f"{k}:{x}".encode(), digest_size=8).digest(), "big", signed=True) for x in s) for k in range(SEEDS)]

    return pd.Series([one(s) for s in shingles])


def _named(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    d = df.select(F.col(id_col).alias("id"), normal_exact(name_col).alias("exact"), normal_fuzzy(name_col).alias("fuzzy"))
    d = d.withColumn("letters", F.replace("fuzzy", F.lit(" "), F.lit("")))
    d = d.withColumn("g", grams("letters", 3))
    clear = (entropy("letters") >= LEAST_ENTROPY) & ((F.char_length("fuzzy") >= 6) | F.contains("fuzzy", F.lit(" ")))
    return d.withColumn("clear", clear)


def _bands(d: DataFrame, *carried: str) -> DataFrame:
    s = d.select("letters", *carried, "g", signature("g").alias("s"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(SEEDS // BAND - 1)), lambda b: F.struct(b.alias("no"), F.xxhash64(F.slice("s", b * BAND + 1, BAND)).alias("h")))
    return s.select("letters", *carried, "g", F.explode(bands).alias("band"))


def resolve(names: DataFrame, known: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(id, match, state): EXACT for one equal known name, SIMILAR for the best of at least ACCEPT, else UNRESOLVED."""
    n, k = _named(names, id_col, name_col), _named(known, id_col, name_col)
    equal = k.groupBy("exact").agg(F.count("*").alias("hits"), F.min("id").alias("hit"))
    # Names with an equal one need no similar one. Of the rest, and of the known, each set of shingles is compared once, under
    # its letters; the known one stands for the smallest id that has it.
    open_ = n.where("clear AND size(g) > 0").join(equal.select("exact"), "exact", "left_anti")
    a = _bands(open_.groupBy("letters").agg(F.first("g").alias("g")))
    b = _bands(k.where("clear AND size(g) > 0").groupBy("letters").agg(F.first("g").alias("g"), F.min("id").alias("other")), "other")
    near = a.alias("a").join(b.alias("b"), F.col("a.band") == F.col("b.band")).select("a.letters", "b.other", jaccard("a.g", "b.g").alias("j")).where(F.col("j") >= ACCEPT)
    best = near.groupBy("letters").agg(F.max_by("other", F.struct("j", -F.col("other"))).alias("best"))
    r = n.select("id", "exact", F.when(F.col("clear") & (F.size("g") > 0), F.col("letters")).alias("letters")).join(equal, "exact", "left").join(best, "letters", "left")
    hits = F.coalesce("hits", F.lit(0))
    return r.select("id", F.when(hits == 1, F.col("hit")).when(hits == 0, F.col("best")).alias("match"), F.when(hits == 1, "EXACT").when((hits == 0) & F.col("best").isNotNull(), "SIMILAR").otherwise("UNRESOLVED").alias("state"))
