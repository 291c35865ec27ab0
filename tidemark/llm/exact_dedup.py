"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text's bytes are cut where the bytes before the cut say so, so that equal passages give equal chunks wherever they
stand. Each different chunk is moved once, to give it a verified identifier; a document is then the list of its chunks'
identifiers, and documents are compared by these lists. No text is moved for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Sealed, store

#: Bytes of a chunk, at least and at most.
LEAST, MOST = 1024, 16384
#: A cut comes after WINDOW bytes of which each is in its place's class; a class has a quarter of all bytes.
WINDOW, SHARE = 4, 64


def normal(text: Column) -> Column:
    """The text with each run of white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r ]{2,}|[\t-\r]", " ")


def _class(place: int) -> str:
    """The bytes b for which b * 167 + 59 * place, modulo 256, is under SHARE, as a class of a regular expression."""
    return "[" + "".join(rf"\x{b:02x}" for b in range(256) if (b * 167 + 59 * place) % 256 < SHARE) + "]"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text's UTF-8 bytes in chunks, each byte as the character of its number; joined they are the text again.

    A cut comes at the first place after `least` bytes where the last WINDOW bytes fall in their classes, or after `most`.
    """
    if not WINDOW < least < most:
        raise ValueError("a chunk needs more bytes than the window, and room for a cut")
    cut = "".join(_class(i) for i in range(WINDOW))
    pattern = rf"(?s).{{{least - WINDOW},{most - WINDOW}}}?{cut}|.{{1,{most}}}"
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(pattern), F.lit(0))


def as_bytes(chunk: Column) -> Column:
    return F.encode(chunk, "ISO-8859-1")


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def _once(texts: DataFrame, text_col: str, least: int, most: int, bits: int) -> DataFrame:
    """(hash, chunk): each different chunk once. Copies go before the shuffle."""
    each = texts.select(F.explode(chunks(normal(F.col(text_col)), least, most)).alias("chunk"))
    return each.select(_hash(F.col("chunk"), bits).alias("hash"), "chunk").distinct()


def _numbered(once: DataFrame) -> DataFrame:
    """Chunks that share a hash, numbered in their order as strings. Of 64 bits there are hardly any."""
    return once.withColumn("alt", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1)


def chunk_store(texts: DataFrame, text_col: str, least: int = LEAST, most: int = MOST, bits: int = 64) -> DataFrame:
    """(hash, alt, chunk): each different chunk once. Of chunks with one hash alt is 0, 1, 2, ..., so (hash, alt) is an
    identifier that was verified by content."""
    return _numbered(_once(texts, text_col, least, most, bits)).select("hash", "alt", "chunk")


def recipes(docs: DataFrame, text_col: str = "text", least: int = LEAST, most: int = MOST, bits: int = 64, keep_text: bool = True) -> DataFrame:
    """docs plus row (a number of its own for each row), hashes and alts (the recipe: identifiers of the chunks in order;
    alts is empty where all are 0) and text_sha256 (of the normalised text), which replace columns of these names.

    The result is a stored table. keep_text=False leaves the text out of it.
    """
    s = Sealed(docs, text_col)
    base = s.df.withColumn("norm__", normal(s[text_col])).withColumn("chunks__", chunks(F.col("norm__"), least, most))
    base = base.withColumns({"row__": F.monotonically_increasing_id(), "hashes__": F.transform("chunks__", lambda c: _hash(c, bits)), "sha__": F.sha2("norm__", 256)})
    kept = [n for n in s.names if keep_text or n != text_col]
    names = [s.inner[n] for n in kept]
    none = F.array().cast("array<int>")
    with Scratch(docs.sparkSession, "recipes") as scratch:
        once = _once(s.df, s.inner[text_col], least, most, bits)
        shared = scratch.store(once.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")
        if shared.isEmpty():
            full = base.select(*names, "row__", "hashes__", none.alias("alts__"), "sha__")
        else:
            # The texts that hold such a chunk look its number up by content; the others stay as they are.
            doubtful = scratch.store(_numbered(once.join(shared, "hash", "left_semi")).where("alt > 0"), "numbered")
            base = scratch.store(base.select(*names, "row__", "hashes__", "sha__", "chunks__"), "cut")
            each = base.select("row__", F.posexplode("chunks__").alias("pos", "chunk")).withColumn("hash", _hash(F.col("chunk"), bits))
            found = each.join(doubtful, ["hash", "chunk"]).groupBy(F.col("row__").alias("of__")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "alt"))).alias("found__"))
            alts = F.transform("hashes__", lambda _, i: F.coalesce(F.try_element_at("found__", i), F.lit(0)))
            full = base.join(found, base["row__"] == found["of__"], "left")
            full = full.select(*names, "row__", "hashes__", F.when(F.col("found__").isNull(), none).otherwise(alts).alias("alts__"), "sha__")
        new = {"row": "row__", "hashes": "hashes__", "alts": "alts__", "text_sha256": "sha__"}
        full = full.select(*[F.col(s.inner[n]).alias(n) for n in kept if n not in new], *[F.col(c).alias(n) for n, c in new.items()])
        return scratch.keep(full, "table")


def rebuild(recipe: DataFrame, chunk: DataFrame) -> DataFrame:
    """(row, text): the normalised texts of recipes() from the chunks of chunk_store()."""
    steps = recipe.select("row", "alts", F.posexplode_outer("hashes").alias("pos", "hash"))
    steps = steps.withColumn("alt", F.coalesce(F.get("alts", F.col("pos")), F.lit(0)))
    parts = steps.join(chunk, ["hash", "alt"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("parts"))
    return parts.select("row", as_bytes(F.array_join(F.transform("parts", lambda p: p["chunk"]), "")).cast("string").alias("text"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **cut: int) -> DataFrame:
    """docs plus keep_id, group_size, kept and text_sha256, which replace columns of these names.

    Texts are equal if they are after normal(); null is the empty text. Of equal texts one row stays: that of the smallest
    id, or one of them if rows repeat; a row with a null id stays only if all have one. An empty table gives an empty
    table. Of a group only a list of numbers and the smallest id are aggregated, before the shuffle as well; the rows get
    their group by a join that Spark splits by size.
    """
    new = ("keep_id", "group_size", "kept", "text_sha256")
    s = Sealed(docs, id_col, text_col)
    r = recipes(s.df, s.inner[text_col], keep_text=keep_text, **cut)
    r = r.withColumn("key", F.xxhash64("hashes", "alts"))
    doc = F.col(s.inner[id_col])
    first = F.coalesce(F.min_by("row", doc), F.min("row"))
    groups = r.groupBy(F.col("key").alias("k"), F.col("hashes").alias("h"), F.col("alts").alias("a")).agg(F.count("*").alias("size"), F.min(doc).alias("first_id"), first.alias("first_row"))
    # Stored, so that the join shuffles both sides and Spark may split a large group's rows.
    g = store(groups.where("size > 1"), "copies")
    j = r.join(g, (F.col("key") == F.col("k")) & (F.col("hashes") == F.col("h")) & (F.col("alts") == F.col("a")), "left")
    out = [F.col(s.inner[n]).alias(n) for n in s.names if n not in new and (keep_text or n != text_col)]
    alone = F.col("size").isNull()
    keep = F.when(alone, doc).otherwise(F.col("first_id"))
    return j.select(*out, keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("first_row"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies, with the columns of docs."""
    s = Sealed(docs, id_col, text_col)
    kept = classes(s.df, s.inner[id_col], s.inner[text_col]).where("kept")
    return s.replace(kept)

