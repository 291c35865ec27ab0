"""Exports that prove themselves: a hash for each record, and a chain over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The format's name (a part of the chain's first link), and records between two links that an export states.
FORMAT, STRETCH = "WATCH_EXPORT_V1", 1024


def _sha(text) -> Column:
    return F.sha2(text, 256)


def _fold(first: Column, hashes: Column) -> Column:
    return F.aggregate(hashes, first, lambda link, h: _sha(F.concat(link, F.lit(":"), h)))


def first_link(watch_sha256: Column) -> Column:
    return _sha(F.concat(F.lit(FORMAT + ":"), watch_sha256))


def manifest(watches: DataFrame, records: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(entries, links) of exports: watches (export, watch), records (export, index, payload), indexes from 0 without gaps.

    entries has (export, index, sha256). links has (export, stretch, link): the chain's value before each stretch of
    records and, in the last row, at the end, which is the root. A link depends on the one before, so an export's hashes
    (not its payloads) are folded in one row.
    """
    entries = records.select("export", "index", _sha("payload").alias("sha256"))
    groups = entries.groupBy("export", F.floor(F.col("index") / stretch).alias("s")).agg(F.array_sort(F.collect_list(F.struct("index", "sha256"))).alias("e"))
    whole = groups.groupBy("export").agg(F.array_sort(F.collect_list(F.struct("s", F.transform("e", lambda x: x["sha256"]).alias("h")))).alias("parts"))
    start = watches.select("export", first_link(_sha("watch")).alias("link")).join(whole, "export", "left")
    none = F.array().cast("array<struct<s:bigint,h:array<string>>>")
    links = F.aggregate(F.coalesce("parts", none), F.array("link"), lambda done, p: F.concat(done, F.array(_fold(F.element_at(done, -1), p["h"]))))
    return entries, start.select("export", F.posexplode(links).alias("stretch", "link"))


def verify(watches: DataFrame, records: DataFrame, stated: DataFrame, entries: DataFrame, links: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(export, state, first_break) of each export of `stated` (export, watch_sha256).

    EXPORT_WATCH_HASH_MISMATCH: the watch isn't the one that was exported. EXPORT_RECORD_HASH_MISMATCH: a record was
    changed, added, removed or moved, the first at index first_break. EXPORT_ROOT_MISMATCH: the chain doesn't lead to the
    stated root, or from one stated link to the next; first_break is the first index of the stretch. VERIFIED: neither.
    Stretches are folded apart from each other, each from the link that is stated before it.
    """
    w = stated.join(watches.select("export", _sha("watch").alias("w_")), "export", "left")
    bad_watch = ~F.coalesce((F.col("w_") == F.col("watch_sha256")), F.lit(False))
    r = records.select("export", "index", _sha("payload").alias("own"))
    both = r.join(entries, ["export", "index"], "full").where(~F.col("own").eqNullSafe(F.col("sha256")))
    changed = both.groupBy("export").agg(F.min("index").alias("record_"))
    parts = entries.groupBy("export", F.floor(F.col("index") / stretch).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("index", "sha256"))).alias("e"))
    ends = links.select("export", (F.col("stretch") - 1).alias("stretch"), F.col("link").alias("end"))
    c = parts.join(links, ["export", "stretch"], "full").join(ends, ["export", "stretch"], "full")
    last = F.col("stretch") == F.max("stretch").over(Window.partitionBy("export"))
    # The first link follows from the watch; the last one has no stretch after it.
    begin = F.when(F.col("stretch") == 0, first_link(F.col("watch_sha256"))).otherwise(F.col("link"))
    c = c.join(stated, "export").withColumn("last", last)
    whole = F.col("e").isNotNull() & F.col("end").isNotNull() & F.coalesce(begin == F.col("link"), F.lit(False)) & F.coalesce(_fold(begin, F.transform("e", lambda x: x["sha256"])) == F.col("end"), F.lit(False))
    root_only = F.col("last") & F.col("e").isNull() & F.col("end").isNull() & F.coalesce(begin == F.col("link"), F.lit(False))
    broken = c.where((F.col("stretch") >= 0) & ~(whole | root_only)).groupBy("export").agg((F.min("stretch") * stretch).alias("chain_"))
    linked = links.groupBy("export").agg(F.count("*").alias("links_"))
    j = w.join(changed, "export", "left").join(broken, "export", "left").join(linked, "export", "left")
    off = F.col("chain_").isNotNull() | F.col("links_").isNull()
    state = F.when(bad_watch, "EXPORT_WATCH_HASH_MISMATCH").when(F.col("record_").isNotNull(), "EXPORT_RECORD_HASH_MISMATCH").when(off, "EXPORT_ROOT_MISMATCH").otherwise("VERIFIED")
    return j.select("export", state.alias("state"), F.when(state == "EXPORT_RECORD_HASH_MISMATCH", F.col("record_")).when(state == "EXPORT_ROOT_MISMATCH", F.coalesce("chain_", F.lit(0))).cast("long").alias("first_break"))
