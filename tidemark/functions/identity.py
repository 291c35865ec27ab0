"""Product codes, URLs and money as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of currencies that don't have two.
MINOR_DIGITS = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "ISK": 0, "BHD": 3, "JOD": 3, "KWD": 3, "OMR": 3, "TND": 3}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def gtin14(code) -> Column:
    """A code of 8, 12, 13 or 14 digits with a right check digit, padded to 14; null otherwise, and for all zeros."""
    c = _c(code)
    digits = F.split(F.reverse(c), "")
    total = F.aggregate(F.transform(digits, lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    ok = c.rlike("^[0-9]+$") & F.length(c).isin(8, 12, 13, 14) & ~c.rlike("^0+$")
    return F.when(ok & (total % 10 == 0), F.lpad(c, 14, "0"))


def with_check_digit(body) -> Column:
    """Digits with the check digit that makes them a valid code."""
    b = _c(body)
    total = F.aggregate(F.transform(F.split(F.reverse(b), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.concat(b, ((10 - total % 10) % 10).cast("string"))


def isbn10_as_gtin(code) -> Column:
    """A valid ISBN-10 as GTIN-14, with prefix 978."""
    c = F.regexp_replace(_c(code), "[- ]", "")
    each = F.transform(F.split(c, ""), lambda d, i: F.when(d.isin("X", "x"), 10).otherwise(d.try_cast("int")) * (10 - i))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.when(c.rlike("^[0-9]{9}[0-9Xx]$") & (total % 11 == 0), F.lpad(with_check_digit(F.concat(F.lit("978"), F.substring(c, 1, 9))), 14, "0"))


def minor_units(value, currency) -> Column:
    """Exact amount in minor units; null where the value has more decimals than the currency, or is no number."""
    v = _c(value).try_cast("decimal(38,6)")
    digits = F.lit(2)
    for code, d in MINOR_DIGITS.items():
        digits = F.when(_c(currency) == code, d).otherwise(digits)
    power = F.when(digits == 0, F.lit(1)).when(digits == 3, F.lit(1000)).otherwise(F.lit(100))
    scaled = v * power
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def canonical_url(url, tracking: tuple[str, ...] = (), sort_query: bool = False) -> Column:
    """http(s) without credentials; no fragment, scheme and host in lower case, default ports dropped, escapes as they
    are, tracking parameters left out and the query sorted if asked. Null for anything else."""
    u = F.regexp_replace(F.btrim(_c(url)), "#.*$", "")
    parts = r"^([A-Za-z]+)://([^/?]+)([^?]*)(?:\?(.*))?$"
    scheme, host, path, q = (F.regexp_extract(u, parts, i) for i in range(1, 5))
    scheme, host = F.lower(scheme), F.lower(host)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    pairs = F.filter(F.split(q, "&"), lambda p: ~F.element_at(F.split(p, "="), 1).isin(*tracking)) if tracking else F.split(q, "&")
    pairs = F.array_sort(pairs) if sort_query else pairs
    q = F.array_join(pairs, "&")
    out = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    ok = scheme.isin("http", "https") & (host != "") & ~F.contains(host, F.lit("@")) & (F.octet_length(_c(url)) <= 8192)
    return F.when(ok, out)


def url_identity(url, **policy) -> Column:
    return F.sha2(canonical_url(url, **policy), 256)


def half_up_bps(amount: Column, bps: Column) -> Column:
    """A share in basis points, half up, of whole minor units."""
    return F.floor((amount * bps + 5000) / 10000).cast("long")


def decision(rejected: Column, missing: Column, exhausted: Column, screened: Column) -> Column:
    return F.when(F.size(rejected) > 0, "REJECTED").when(F.size(missing) == 0, "SHORTLISTED").when(exhausted, "INSUFFICIENT_EVIDENCE").when(screened, "SCREENED").otherwise("VALIDATING")
