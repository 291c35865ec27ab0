"""Times and freshness of HTTP and feed documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rfc3339(x) -> Column:
    """Seconds of a strict RFC 3339 time; null for anything else."""
    shape = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
    return F.when(_c(x).rlike(shape), F.unix_seconds(F.try_to_timestamp(F.upper(_c(x)))))


def rfc822(x) -> Column:
    """Seconds of a feed's date, with or without a weekday; zones as offsets or GMT."""
    t = F.regexp_replace(F.regexp_replace(F.btrim(_c(x)), r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UT|UTC|Z)$", "+0000")
    return F.unix_seconds(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss xx")))


def http_date(x) -> Column:
    """Seconds of a date in one of the three HTTP forms, each of which is in UTC."""
    t = F.btrim(F.regexp_replace(_c(x), r"\s+", " "))
    t = F.regexp_replace(t, r"^[A-Za-z]+,? ", "")
    # Years of two digits from 70 are of the last century.
    t = F.regexp_replace(F.regexp_replace(t, r"^(\d+-[A-Za-z]{3}-)([7-9]\d) ", "$119$2 "), r"^(\d+-[A-Za-z]{3}-)([0-6]\d) ", "$120$2 ")
    forms = (r"d MMM yyyy HH:mm:ss 'GMT' xx", "d-MMM-yyyy HH:mm:ss 'GMT' xx", "MMM d HH:mm:ss yyyy xx")
    return F.unix_seconds(F.coalesce(*[F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(f)) for f in forms]))


def retry_not_before(header, now: Column) -> Column:
    """When a Retry-After header lets a client come back: seconds from now, or a date."""
    h = F.btrim(_c(header))
    return F.when(h.rlike(r"^\d{1,18}$"), now + h.try_cast("long")).otherwise(http_date(h))


def freshness_lifetime(cache_control, date, expires, last_modified) -> Column:
    """Seconds that a response is fresh: max-age, else Expires less Date, else a tenth of its age; 0 if it mustn't be kept."""
    cc = F.lower(F.coalesce(_c(cache_control), F.lit("")))
    age = F.regexp_extract(cc, r"(?:^|[,\s])max-age\s*=\s*\"?(\d+)", 1).try_cast("long")
    # greatest() skips nulls: what isn't told stays null.
    told, old = http_date(expires) - http_date(date), http_date(date) - http_date(last_modified)
    told, guess = F.when(told.isNotNull(), F.greatest(F.lit(0), told)), F.when(old.isNotNull(), F.greatest(F.lit(0), F.floor(old / 10)))
    return F.when(cc.rlike(r"(^|[,\s])(no-store|no-cache)\b"), 0).otherwise(F.coalesce(age, told, guess, F.lit(0)))
