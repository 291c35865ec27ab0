"""Line deduplication across documents, in DataFrame operations only.

Lines are exploded, normalised and hashed; a hash found in enough distinct documents loses all its lines except those
of the document with the smallest id; what stays is joined again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Sealed, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. lower() is the same on pure ASCII, and faster."""
    t = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _dense(p: Column) -> Column:
    """From sorted positions to an array of flags by position, so that a look-up costs the same for any number of lines."""
    flags = F.transform(p, lambda x, i: F.concat(F.array_repeat(F.lit(False), F.when(i == 0, x).otherwise(x - F.get(p, i - 1) - 1)), F.array(F.lit(True))))
    return F.flatten(flags)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines dropped from the text, plus n_lines (before) and n_dropped, which replace columns of these names.

    A null or empty text has one empty line. Rows that share an id are one document. Rows with a null id are neither
    counted nor changed. Keys under min_chars code points never count. An empty table gives an empty table. Hashes have
    128 bits. Rows of a hot key are counted before the shuffle; their join is one that Spark splits by size.
    """
    s = Sealed(docs, id_col, text_col)
    doc, text = s[id_col], F.coalesce(s[text_col], F.lit(""))
    tag = F.hash(text).cast("long")  # tells rows apart that share an id and differ in text
    lines = s.df.where(doc.isNotNull()).select(doc.alias("doc"), tag.alias("tag"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    at = F.shiftleft("tag", 32).bitwiseOR(F.col("pos").cast("long"))
    hashed = lines.select("doc", at.alias("at"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    if min_docs == 2:
        spread = hashed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    else:
        once = hashed.select("h1", "h2", "doc").distinct()
        spread = once.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    repeated = store(spread, "repeated-lines")
    gone = hashed.join(repeated, ["h1", "h2"]).where("doc > first")
    gone = gone.groupBy("doc", F.shiftright("at", 32).alias("tag")).agg(F.array_sort(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("p"))
    gone = gone.select("doc", "tag", F.size("p").alias("n"), _dense(F.col("p")).alias("gone"))
    both = s.df.withColumn("tag__", tag).join(gone, (doc == F.col("doc")) & (F.col("tag__") == F.col("tag")), "left")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    new = {text_col: F.when(F.col("gone").isNull(), s[text_col]).otherwise(kept)}
    counts = {"n_lines": F.size(parts).cast("long"), "n_dropped": F.coalesce(F.col("n"), F.lit(0)).cast("long")}
    old = [new.get(n, s[n]).alias(n) for n in s.names if n not in counts]
    return both.select(*old, *[c.alias(k) for k, c in counts.items()])
