"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix is the point frac(i * golden ratio), held as a 64-bit integer, mapped through the cumulative target
weights to a source. The k-th slot of a source takes the k-th block of equal size of that source's documents in
shuffled order; a source that is taken more than once starts again from its first word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Sealed, store

#: floor(2^64 / golden ratio), odd.
GOLDEN = 0x9E3779B97F4A7C15
#: Slots in a chunk that is ranked at once; documents of a source in a bucket that is summed up at once.
CHUNK, BUCKET = 65_536, 1_024


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in code point order, null last. sizes: one row per source.

    Sources weigh as weights say, repeating; together they get share times all sizes; none gets over most times its
    own, and what is over goes to the others by weight. The list of sources is a table of names: it comes to the driver.
    """
    rows = sorted(((r["source"], int(r["size"] or 0)) for r in sizes.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(rows))]
    total, out, free = share * sum(n for _, n in rows), [0.0] * len(rows), set(range(len(rows)))
    while free:
        level = total / sum(w[i] for i in free)
        over = {i for i in free if level * w[i] > most * rows[i][1]}
        if not over:
            for i in free:
                out[i] = level * w[i]
            break
        for i in over:
            out[i] = most * rows[i][1]
            total -= out[i]
        free -= over
    return [(name, n, t) for (name, n), t in zip(rows, out, strict=True)]


def _schedule(cum: np.ndarray, need: np.ndarray, length: int):
    """Slots in chunks: (source number, chunk, rank within the chunk, slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_pylist():
                i = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, length), dtype=np.uint64)
                src = np.minimum(np.searchsorted(cum, i * np.uint64(GOLDEN), side="right"), len(cum) - 1)
                order = np.argsort(src, kind="stable")
                s = src[order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
                rank = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
                yield pa.record_batch({"sid": pa.array(s.astype(np.int32)), "chunk": pa.array(np.full(len(s), chunk, np.int64)), "r": pa.array(rank.astype(np.int64)), "slot": pa.array(i[order].astype(np.int64))})

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 2048, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, pieces).

    sized: row_id, doc (the id), sid (the source's number), size, source_size and target, one row per row of docs.
    pieces: the mix. Each row is a run of words that a slot takes from one document: slot, row_id, doc, h (a hash of the
    id and the text), epoch, start word in the document, words. text_of() makes texts of them.

    A null text has size 0; null is a source of its own, and sorts last. Rows that are equal in all they are sized by
    are told apart by a count, so that repeated rows are each mixed. Documents without words get no pieces. An empty
    table gives two empty tables. Reruns agree: order depends on contents and seed only.
    """
    spark = docs.sparkSession
    s = Sealed(docs, id_col, text_col, source_col)
    text = F.coalesce(s[text_col], F.lit(""))
    d = s.df.withColumns({"h": F.xxhash64(F.lit(seed), s[id_col], text), "size_": F.regexp_count(text, F.lit(SPACE.replace("[", "[^") + "+")).cast("long")})
    slim = store(d.select(s[source_col].alias("source"), s[id_col].alias("id"), "h", "size_"), "sizes")
    per = slim.groupBy("source").agg(F.sum("size_").alias("size"), F.count("*").alias("n"))
    per = store(per, "source-sizes")
    rows = targets(per, weights, share, most)
    known = spark.createDataFrame([(i, name, n, float(t)) for i, (name, n, t) in enumerate(rows)], "sid int, source string, source_size long, target double")

    # Documents in shuffled order: by hash, first in buckets of it, then within each.
    counted = per.agg(F.max("n")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(max(1, counted / BUCKET))))
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    b = slim.join(known, slim["source"].eqNullSafe(known["source"])).select("sid", "id", "h", "size_", "source_size", "target", bucket.alias("bucket"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "id")
    sums = b.groupBy("sid", "bucket").agg(F.sum("size_").alias("all_"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("all_").over(before), F.lit(0)).alias("base"))
    at = b.select("*", F.row_number().over(inside).alias("k"), F.coalesce(F.sum("size_").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("within"))
    at = at.join(sums, ["sid", "bucket"]).select("sid", "id", "h", "k", "bucket", "size_", "source_size", "target", (F.col("base") + F.col("within")).alias("a"))

    # Each run of a document through the stream of its source, cut at blocks and at the target.
    limit = F.round("target").cast("long")
    runs = at.where("size_ > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int")))))
    lo = F.col("a") + F.col("epoch") * F.col("source_size")
    runs = runs.withColumns({"lo": lo, "hi": F.least(lo + F.col("size_"), limit)}).where("hi > lo")
    cut = runs.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    piece = {"from_": F.greatest("lo", F.col("rank") * block), "to_": F.least("hi", (F.col("rank") + 1) * block)}
    cut = cut.withColumns(piece).select("sid", "rank", "id", "h", "k", "bucket", "epoch", (F.col("from_") - F.col("lo")).cast("long").alias("start"), (F.col("to_") - F.col("from_")).cast("long").alias("words"))

    slots = _ranked_slots(spark, rows, block)
    row_id = F.concat_ws("-", "sid", F.hex("h"), "bucket", "k")
    pieces = cut.join(slots, ["sid", "rank"]).select("slot", row_id.alias("row_id"), F.col("id").alias("doc"), "h", "epoch", "start", "words")
    sized = at.select(row_id.alias("row_id"), F.col("id").alias("doc"), "sid", F.col("size_").alias("size"), "source_size", "target")
    return sized, pieces


def _ranked_slots(spark, rows, block: int) -> DataFrame:
    """(sid, rank, slot): slots until each source has as many as its target asks for.

    The points in a stretch of the weights deviate from their share by under 2 + log(n) / log(golden ratio), so the
    schedule is longer by that for the source of least weight; slots past a source's need join no block.
    """
    schema = "sid int, rank long, slot long"
    need = np.array([math.ceil(round(t) / block) for _, _, t in rows], dtype=np.float64)
    if need.sum() == 0:
        return spark.createDataFrame([], schema)
    p = need / need.sum()
    n = need.sum()
    for _ in range(8):
        n = max((k + 4 + math.log(n + 2) / math.log((1 + 5**0.5) / 2)) / q for k, q in zip(need, p, strict=True) if q)
    length = math.ceil(n)
    edges = [int(x * 2**64) for x in np.cumsum(p)]
    cum = np.array([min(x, 2**64 - 1) for x in edges], dtype=np.uint64)
    chunks = math.ceil(length / CHUNK)
    made = spark.range(0, chunks, 1, min(chunks, 4096)).mapInArrow(_schedule(cum, need, length), "sid int, chunk long, r long, slot long")
    per = made.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("sid", "chunk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return made.join(per, ["sid", "chunk"]).select("sid", (F.col("base") + F.col("r")).alias("rank"), "slot")


def taken(sized: DataFrame, pieces: DataFrame) -> DataFrame:
    """sized with the words that the mix takes from each document, repeats counted."""
    sums = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return sized.join(sums, "row_id", "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long"))


def text_of(docs: DataFrame, pieces: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, row_id, epoch, start, text): the words of each piece with single spaces, for the docs and seed of mix().

    A text is sent once for each of its pieces; rows with equal id and text are one here, their words being the same.
    """
    s = Sealed(docs, id_col, text_col)
    text = F.coalesce(s[text_col], F.lit(""))
    texts = s.df.select(F.xxhash64(F.lit(seed), s[id_col], text).alias("h"), text.alias("text_")).groupBy("h").agg(F.min("text_").alias("text_"))
    words = F.regexp_extract_all("text_", F.lit("(" + SPACE.replace("[", "[^") + "+)"))
    cut = F.array_join(F.slice(words, F.col("start").cast("int") + 1, F.col("words").cast("int")), " ")
    return pieces.join(texts, "h").select("slot", "row_id", "epoch", "start", cut.alias("text"))
