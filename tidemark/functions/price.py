"""Prices in text: which separator is the decimal one, and the exact amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols and codes of currencies, the longest first.
SYMBOLS = {"US$": "USD", "HK$": "HKD", "C$": "CAD", "A$": "AUD", "R$": "BRL", "円": "JPY", "¥": "JPY", "￥": "JPY", "€": "EUR", "£": "GBP", "₩": "KRW", "₹": "INR", "$": "USD"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def currency(x) -> Column:
    """The currency of the first symbol or three-letter code in a text."""
    import re

    shape = "|".join(map(re.escape, SYMBOLS)) + r"|\b(?:USD|EUR|GBP|JPY|KRW|CAD|AUD|CNY|INR|BRL|CHF|SEK)\b"
    hit = F.regexp_extract(_c(x), f"({shape})", 1)
    out = F.when(hit.rlike("^[A-Z]{3}$"), hit)
    for s, code in SYMBOLS.items():
        out = F.when(hit == s, code).otherwise(out)
    return out


def amount(x) -> Column:
    """The first number of a text as exact decimal text; null without one.

    With both separators the later one is decimal. A lone one is decimal unless exactly three digits follow each of
    it. Spaces and apostrophes between digits are groups.
    """
    n = F.regexp_extract(_c(x), r"(\d[\d.,' \x{00A0}\x{202F}]*)", 1)
    n = F.regexp_replace(F.regexp_replace(n, r"[' \x{00A0}\x{202F}]", ""), r"[.,]+$", "")
    dots, commas = F.length(F.regexp_replace(n, "[^.]", "")), F.length(F.regexp_replace(n, "[^,]", ""))
    last_comma = F.length(n) - F.instr(F.reverse(n), ",") > F.length(n) - F.instr(F.reverse(n), ".")
    grouped_dot, grouped_comma = n.rlike(r"^\d{1,3}(\.\d{3})+$"), n.rlike(r"^\d{1,3}(,\d{3})+$")
    no_dots, no_commas = F.replace(n, F.lit("."), F.lit("")), F.replace(n, F.lit(","), F.lit(""))
    out = (
        F.when((dots > 0) & (commas > 0), F.when(last_comma, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(dots > 0, F.when(grouped_dot | (dots > 1), no_dots).otherwise(n))
        .when(commas > 0, F.when(grouped_comma | (commas > 1), no_commas).otherwise(F.replace(n, F.lit(","), F.lit("."))))
        .otherwise(n)
    )
    return F.when(n != "", F.regexp_replace(out, r"^0+(?=\d)", ""))
