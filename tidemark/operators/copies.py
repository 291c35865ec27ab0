"""Copies of texts: equal after normalising, similar by character 5-grams, or one held in the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import copy_normal, grams

# Fixed values.
JACCARD, CONTAINMENT, CONTAINED_CHARS, LEAST_CHARS = 0.8, 0.9, 40, 12


def copy_pairs(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b), a < b: pairs of copies.

    Each text is found by its rarest grams: a copy shares at least one of the rarest fifth of its grams, or, for one
    held in another, of the rarest tenth of the shorter; so common grams make no pairs.
    """
    t = texts.select(F.col(id_col).alias("id"), copy_normal(text_col).alias("t")).where(F.char_length("t") >= LEAST_CHARS)
    t = t.withColumns({"g": grams("t", 5), "n": F.size(grams("t", 5)), "chars": F.char_length("t")})
    each = t.select("id", "n", "chars", F.explode("g").alias("gram"))
    rarity = each.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "gram")
    ranked = each.join(rarity, "gram").withColumn("k", F.row_number().over(order))
    probe = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * JACCARD) + 1)
    near = probe.alias("x").join(probe.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= JACCARD * F.greatest("x.n", "y.n")))
    rare = ranked.where((F.col("chars") >= CONTAINED_CHARS) & (F.col("k") <= F.col("n") - F.ceil(F.col("n") * CONTAINMENT) + 1))
    held = rare.alias("x").join(ranked.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") != F.col("y.id")) & (F.col("x.n") <= F.col("y.n")))
    pairs = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).union(held.select(F.least("x.id", "y.id"), F.greatest("x.id", "y.id"))).distinct()
    left, right = (t.select(F.col("id").alias(s), F.col("g").alias(f"g{s}"), F.col("n").alias(f"n{s}"), F.col("chars").alias(f"c{s}")) for s in "ab")
    j = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("ga", "gb"))
    similar = both >= JACCARD * (F.col("na") + F.col("nb") - both) - 1e-9
    contained = (F.least("ca", "cb") >= CONTAINED_CHARS) & (both >= CONTAINMENT * F.least("na", "nb") - 1e-9)
    return j.where(similar | contained).select("a", "b")
