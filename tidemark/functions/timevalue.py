"""Time values as the dialect reads them: text in several forms, Julian day numbers and Unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of a day and of the Unix epoch since Julian day 0, the first Julian day that isn't read any
# more, and the range of Unix seconds.
DAY_MS, EPOCH_MS, JULIAN_END, UNIX_RANGE = 86_400_000, 210_866_760_000_000, 5_373_484.5, (-210_866_760_000, 253_402_300_799)

_DATE = r"^(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?:[T\x20\x09-\x0D]*$|[T\x20\x09-\x0D]*(?=\d))"
_TIME = r"(?:([01]\d|2[0-4]):([0-5]\d)(?::([0-5]\d)(?:\.(\d+))?)?[\x20\x09-\x0D]*(?:([Zz])|([+-])(0\d|1[0-4]):([0-5]\d))?[\x20\x09-\x0D]*)$"
_NUMBER = r"^[\x20\x09-\x0D]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[\x20\x09-\x0D]*$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def from_millis(ms: Column) -> Column:
    """Unix milliseconds as a timestamp without zone, whatever the session's zone is."""
    return _epoch() + F.make_dt_interval(secs=(ms.cast("decimal(18,0)") / 1000).cast("decimal(18,6)"))


def to_seconds(ts) -> Column:
    """Seconds since 1970 of a timestamp without zone, as a decimal, whatever the session's zone is."""
    return (_c(ts).cast("timestamp_ntz") - _epoch()).cast("interval second").cast("decimal(20,6)")


def _julian(r: Column) -> Column:
    return F.when((r >= 0) & (r < JULIAN_END), F.floor(r * float(DAY_MS) + 0.5) - EPOCH_MS)


def _unix(r: Column) -> Column:
    return F.when((r >= UNIX_RANGE[0]) & (r <= UNIX_RANGE[1]), F.floor(r * 1000.0 + 0.5))


def number_value(r, mode: str | None = None) -> Column:
    """A number as a timestamp: a Julian day, Unix seconds ('unixepoch'), or whichever it must be ('auto'); null out of range."""
    r = _c(r).cast("double")
    if mode == "unixepoch":
        ms = _unix(r)
    elif mode == "auto":
        ms = F.coalesce(_julian(r), _unix(r))
    elif mode in (None, "julianday"):
        ms = _julian(r)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return from_millis(ms)


def time_value(text, mode: str | None = None) -> Column:
    """A text as a timestamp without zone, to the millisecond; null if it is none.

    Forms: YYYY-MM-DD, HH:MM, HH:MM:SS and HH:MM:SS.fff (on 1 January 2000), a date and a time with a T or white space or
    nothing between, a zone (Z or an offset, which is taken off) after a time, 'now', and numbers as for number_value().
    Days that a month doesn't have run over into the next, and hour 24 into the next day. With 'unixepoch' and 'julianday'
    numbers alone are read; 'auto' reads other forms as they are. Years are 0000 to 9999.
    """
    t = _c(text)
    number = F.when(t.rlike(_NUMBER), F.btrim(t, F.lit(" \t\n\x0b\x0c\r")).try_cast("double"))
    numeric = number_value(number, mode)
    if mode in ("unixepoch", "julianday"):
        return numeric
    dated = t.rlike(_DATE)
    part = lambda i: F.regexp_extract(t, _DATE, i).try_cast("int")
    rest = F.when(dated, F.regexp_replace(t, _DATE, "")).otherwise(t)
    of = lambda i: F.coalesce(F.regexp_extract(rest, "^" + _TIME, i).try_cast("long"), F.lit(0))
    timed = rest.rlike("^" + _TIME)
    fraction = F.regexp_extract(rest, "^" + _TIME, 4)
    # Beyond 0.999 a fraction stays below the next second; it is rounded to milliseconds with the seconds.
    ms = F.floor((of(3).cast("double") + F.least(F.coalesce(F.concat(F.lit("0."), fraction).try_cast("double"), F.lit(0.0)), F.lit(0.999))) * 1000 + 0.5)
    offset = F.when(F.regexp_extract(rest, "^" + _TIME, 6) == "-", -1).otherwise(1) * (of(7) * 60 + of(8))
    days = F.when(dated, F.datediff(F.make_date(part(1), part(2), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") + part(3) - 1).otherwise(F.lit(10_957))
    clock = F.when(timed, (of(1) * 60 + of(2) - offset) * 60_000 + ms).otherwise(F.lit(0).cast("long"))
    ok = (dated & ((rest == "") | timed)) | (~dated & timed)
    now = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS"))
    return F.when(F.lower(t) == "now", now).when(ok, from_millis(days * DAY_MS + clock)).otherwise(numeric)
