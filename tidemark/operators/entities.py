"""Entity resolution of product records: a cascade of identity keys, anchors between them, and conflicting fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import identity as i

#: Fields that state a product code, and the fields of a record in its order.
CODES = ("gtin", "ean", "upc", "gtin8", "gtin14")
FIELDS = ("title", "brand", "sku", *CODES, "isbn", "asin", "mpn", "model", "color", "size")


def plain(name: str) -> Column:
    """A stated text in lower case with single spaces; empty for null."""
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(F.col(name)), r"\s+", " ")), F.lit(""))


def origin(url: str) -> Column:
    """Scheme, host and port of an http(s) address; null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(F.col(url), r"^(?i:(https?://[^/?#@]+))", 1)), F.lit(""))


def isbn_as_gtin(name: str) -> Column:
    """An ISBN of 10 or 13 digits, hyphens and spaces left out, as GTIN-14; null unless its check digit and prefix are right."""
    c = F.regexp_replace(F.col(name), "[- ]", "")
    return F.when(F.length(c) == 13, F.when(c.rlike("^97[89]"), i.gtin14(c))).otherwise(i.isbn10_as_gtin(c))


def claims(records: DataFrame, id_col: str) -> DataFrame:
    """(id_col, field, stated, state, gtin14): what can be said of every stated code. Nothing is repaired."""
    rows = []
    for f in (*CODES, "isbn"):
        stated = F.col(f)
        if f == "isbn":
            short = F.length(F.regexp_replace(stated, "[- ]", "")) == 10
            long = F.regexp_replace(stated, "[- ]", "").rlike("^[0-9]{13}$")
            code = isbn_as_gtin(f)
            state = F.when(code.isNotNull() & short, "VALID_ISBN10_CONVERTED_TO_GTIN13").when(code.isNotNull(), "VALID_ISBN13_AS_GTIN13")
            state = state.when(short, "INVALID_ISBN10").when(long, "INVALID_CHECK_DIGIT_OR_PREFIX").otherwise("MALFORMED")
        else:
            code = i.gtin14(stated)
            digits = stated.rlike("^[0-9]+$") & F.length(stated).isin(8, 12, 13, 14)
            state = F.when(code.isNotNull(), "VALID_GTIN").when(digits, "INVALID_CHECK_DIGIT").otherwise("MALFORMED")
        rows.append(F.when(F.btrim(stated) != "", F.struct(F.lit(f).alias("field"), stated.alias("stated"), state.alias("state"), code.alias("gtin14"))))
    return records.select(id_col, F.explode(F.array_compact(F.array(*rows))).alias("c")).select(id_col, "c.*")


def keyed(records: DataFrame) -> DataFrame:
    """records plus identity and basis: the first key that a record's fields allow.

    One valid code; several valid codes, which are a conflict and merge with nothing; an ASIN within its marketplace;
    brand with MPN or model; an article number within its origin; else only the page and its title. Colour and size
    are part of every key.
    """
    variant = F.concat_ws("|", plain("color"), plain("size"))
    codes = F.array_sort(F.array_distinct(F.array_compact(F.array(*[i.gtin14(F.col(c)) for c in CODES], isbn_as_gtin("isbn")))))
    asin, brand, sku, source = F.upper(F.col("asin")), plain("brand"), plain("sku"), F.coalesce(F.col("source"), F.lit(""))
    host = F.regexp_replace(F.coalesce(origin("source"), F.lit("")), r"^https?://(www\.)?|:[0-9]+$", "")
    scope = F.when(host == "amazon.co.jp", "AMAZON_JP").when(host == "amazon.com", "AMAZON_US").otherwise(F.coalesce(origin("source"), F.lit("UNKNOWN_ORIGIN")))
    made = lambda name: F.concat_ws(":", F.lit(name), brand, plain(name), variant, F.lit("sku"), sku)
    branded = lambda name: (brand != "") & (plain(name) != "")
    steps = [
        (F.size("codes_") == 1, F.concat_ws(":", F.lit("gtin"), F.col("codes_")[0], variant), "CHECKSUM_VALID_GTIN_AND_VARIANT"),
        (F.size("codes_") > 1, F.concat_ws(":", F.lit("gtin_conflict"), F.array_join("codes_", "+"), source, variant), "CONFLICTING_GTIN_CLAIMS"),
        (asin.rlike("^[A-Z0-9]{10}$"), F.concat_ws(":", F.lit("asin"), scope, asin, variant), "ASIN_AND_VARIANT"),
        (branded("mpn"), made("mpn"), "BRAND_MANUFACTURER_IDENTIFIER_AND_VARIANT"),
        (branded("model"), made("model"), "BRAND_MANUFACTURER_IDENTIFIER_AND_VARIANT"),
        ((sku != "") & origin("source").isNotNull(), F.concat_ws(":", F.lit("sku"), origin("source"), brand, sku, variant), "ORIGIN_SCOPED_SKU_AND_VARIANT"),
        (F.lit(True), F.concat_ws(":", F.lit("page"), source, plain("title"), variant), "EXACT_PAGE_TITLE_AND_VARIANT_ONLY"),
    ]
    first = reduce(lambda w, s: w.when(s[0], F.struct(s[1].alias("identity"), F.lit(s[2]).alias("basis"))), steps[1:], F.when(steps[0][0], F.struct(steps[0][1].alias("identity"), F.lit(steps[0][2]).alias("basis"))))
    return records.withColumn("codes_", codes).withColumn("k_", first).select(*records.columns, "k_.identity", "k_.basis")


def _sole(rows: DataFrame, key: str) -> DataFrame:
    """(key, sole): keys that belong to exactly one identity."""
    return rows.groupBy(key).agg(F.min("identity").alias("sole"), F.max("identity").alias("last_")).where("sole = last_").drop("last_")


def resolved(records: DataFrame) -> DataFrame:
    """keyed(records) with weak keys replaced where one strong identity stands behind them.

    An article number goes to the only coded identity of its origin, number and variant, unless the record states a
    code itself; a bare page title goes to the only other identity of its page and title, if neither names a variant.
    Both are joins with aggregates by anchor, so an anchor of many records combines before it is shuffled.
    """
    k = keyed(records)
    k = k.withColumns({"article_": F.when((plain("sku") != "") & origin("source").isNotNull(), F.concat_ws("|", origin("source"), plain("sku"), plain("color"), plain("size"))), "page_": F.concat_ws("|", F.coalesce("source", F.lit("")), plain("title"))})
    bare = (plain("color") == "") & (plain("size") == "")
    weak = F.col("basis") == "EXACT_PAGE_TITLE_AND_VARIANT_ONLY"
    by_article = _sole(k.where((F.col("basis") == "CHECKSUM_VALID_GTIN_AND_VARIANT") & F.col("article_").isNotNull()), "article_").withColumnRenamed("sole", "coded_")
    by_page = _sole(k.where(~weak & bare), "page_").withColumnRenamed("sole", "named_")
    silent = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in (*CODES, "isbn")])
    j = k.join(by_article, "article_", "left").join(by_page, "page_", "left")
    better = F.when((F.col("basis") == "ORIGIN_SCOPED_SKU_AND_VARIANT") & silent, F.col("coded_")).when(weak & bare, F.col("named_"))
    return j.select(*records.columns, F.coalesce(better, F.col("identity")).alias("identity"), "basis")


def entities(records: DataFrame, id_col: str) -> DataFrame:
    """(identity, members, sources, first, conflicts, one column per field): a row per entity of resolved(records).

    A field on which its records differ is null and listed in conflicts; one that only some of them state holds.
    """
    agg = [F.count("*").alias("members"), F.count_distinct("source").alias("sources"), F.min(id_col).alias("first")]
    for f in FIELDS:
        agg += [F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}")]
    g = resolved(records).groupBy("identity").agg(*agg)
    split = [F.when(F.col(f"lo_{f}") != F.col(f"hi_{f}"), F.lit(f)) for f in FIELDS]
    return g.select("identity", "members", "sources", "first", F.array_compact(F.array(*split)).alias("conflicts"), *[F.when(F.col(f"lo_{f}") == F.col(f"hi_{f}"), F.col(f"lo_{f}")).alias(f) for f in FIELDS])


def link_state(kind: Column, value: Column, other_kind: Column, other: Column, market: Column, other_market: Column) -> Column:
    """What two stated identifiers say about each other."""
    gtin = F.when(i.gtin14(value).isNotNull(), "EXACT_IDENTIFIER").when(value.rlike("^[0-9]+$") & F.length(value).isin(8, 12, 13, 14), "CONFLICT").otherwise("DERIVED_WEAK_MATCH")
    asin = F.when(value.rlike("^[A-Z0-9]{10}$") & (market == other_market), "EXACT_IDENTIFIER").otherwise("DERIVED_WEAK_MATCH")
    same = F.when(kind == "GTIN", gtin).when(kind == "ASIN", asin).when(kind.isin("URL", "SKU", "MPN"), "SOURCE_ASSERTED").otherwise("DERIVED_WEAK_MATCH")
    differ = F.when(kind == "GTIN", "CONFLICT").otherwise("DERIVED_WEAK_MATCH")
    return F.when(~kind.eqNullSafe(other_kind) | value.isNull() | other.isNull(), "UNRESOLVED").when(value != other, differ).otherwise(same)
