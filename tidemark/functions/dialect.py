"""Embedded-SQL semantics as Column expressions: where Spark's own functions differ, these give the dialect's result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timevalue import to_seconds

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest numeric prefix of a text.
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lower(x) -> Column:
    """ASCII letters only."""
    return F.translate(_c(x), UPPER, LOWER)


def upper(x) -> Column:
    return F.translate(_c(x), LOWER, UPPER)


def real_prefix(x) -> Column:
    """The number a text begins with, 0 without one; null stays null."""
    p = F.regexp_extract(_c(x), NUMBER, 1)
    return F.when(_c(x).isNull(), None).otherwise(F.when(p == "", 0.0).otherwise(p.try_cast("double")))


def int_prefix(x) -> Column:
    p = F.regexp_extract(_c(x), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(_c(x).isNull(), None).otherwise(F.when(p == "", 0).otherwise(p.try_cast("long")))


def add(a, b) -> Column:
    """Integers that overflow become reals."""
    return F.coalesce(F.try_add(_c(a), _c(b)).cast("double"), _c(a).cast("double") + _c(b).cast("double"))


def int_divide(a, b) -> Column:
    """Truncating; null on division by zero."""
    a, b = _c(a), F.nullif(_c(b), F.lit(0))
    q = F.floor(F.abs(a.cast("decimal(20,0)")) / F.abs(b.cast("decimal(20,0)")))
    return (q * F.signum(a.cast("double")).cast("int") * F.signum(b.cast("double")).cast("int")).cast("long")


def modulo(a, b) -> Column:
    return F.try_mod(_c(a), _c(b))


def shift_left(a, n) -> Column:
    """64 and more give 0; a negative count shifts right."""
    a, n = _c(a), _c(n)
    left = F.when(n >= 64, F.lit(0)).otherwise(F.call_function("shiftleft", a, n.cast("int")))
    right = F.when(n <= -64, F.when(a < 0, -1).otherwise(0)).otherwise(F.call_function("shiftright", a, (-n).cast("int")))
    return F.when(n >= 0, left).otherwise(right)


def like(x, pattern: str) -> Column:
    """ASCII case is ignored; there is no escape character."""
    return lower(x).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def least(*xs) -> Column:
    """Null if any argument is."""
    return F.when(_any_null(xs), None).otherwise(F.least(*[_c(x) for x in xs]))


def greatest(*xs) -> Column:
    return F.when(_any_null(xs), None).otherwise(F.greatest(*[_c(x) for x in xs]))


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | _c(x).isNull()
    return out


def substr(x, start: int, length: int | None = None) -> Column:
    """1-based; start 0 costs one character of the length; negative starts count from the end; a negative length takes
    the characters before the start."""
    x = _c(x)
    n = F.char_length(x)
    if start > 0:
        p1 = F.lit(start)
    elif start < 0:
        p1 = n + start + 1
    else:
        p1 = F.lit(0)
    if length is None:
        lo, hi = p1, n
    elif length >= 0:
        lo, hi = p1, p1 + length - 1
    else:
        lo, hi = p1 + length, p1 - 1
    lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, n)
    return F.when(x.isNull(), None).otherwise(F.when(hi < lo, "").otherwise(x.substr(lo, hi - lo + 1)))


def replace(x, old: str, new: str) -> Column:
    return _c(x) if old == "" else F.replace(_c(x), F.lit(old), F.lit(new))


def round_half_away(x, digits: int = 0) -> Column:
    return F.round(_c(x).cast("double"), max(0, min(30, digits)))


def in_list(x, values: list) -> Column:
    """An empty list is false, but null for a null."""
    return _c(x).isin(values) if values else F.when(_c(x).isNull(), None).otherwise(F.lit(False))


def type_name(x) -> Column:
    x = _c(x)
    t = F.typeof(x)
    kind = F.when(t.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer").when(t.isin("float", "double") | t.startswith("decimal"), "real").when(t == "binary", "blob").otherwise("text")
    return F.when(x.isNull(), "null").otherwise(kind)


def json_extract(doc, path: str) -> Column:
    """A value at a path; booleans are 1 and 0; a missing one is null; negative indexes '[#-n]' count from the end.

    A malformed document is an error, and so is a path that doesn't begin with '$'.
    """
    import re

    if not path.startswith("$"):
        raise ValueError(f"not a path: {path}")
    x = F.when(_c(doc).isNotNull() & F.try_parse_json(_c(doc)).isNull(), F.raise_error(F.lit("malformed JSON")).cast("string")).otherwise(_c(doc))
    for part in re.split(r"(\[#-\d+\])", path.removeprefix("$")):
        if m := re.fullmatch(r"\[#-(\d+)\]", part):
            items = F.from_json(x, "array<string>")
            x = F.when(F.size(items) >= int(m[1]), F.element_at(items, -int(m[1])))
        elif part:
            x = F.get_json_object(x, "$" + part)
    if "[#" in path:
        return F.when(x == "true", "1").when(x == "false", "0").otherwise(x)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(doc)), path, "variant"))
    return F.when((kind == "BOOLEAN") & (x == "true"), "1").when((kind == "BOOLEAN") & (x == "false"), "0").otherwise(x)


def julian_day(ts) -> Column:
    """Days since noon of 24 November 4714 BC, of a timestamp without zone, whatever the session's zone is."""
    return to_seconds(ts).cast("double") / F.lit(86_400.0) + 2440587.5


def unix_epoch(ts) -> Column:
    return F.floor(to_seconds(ts)).cast("long")


#: strftime specifiers with a direct date_format pattern.
FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "I": "hh", "p": "a", "j": "DDD"}


def strftime(fmt: str, ts) -> Column:
    """Null if the format has an unknown specifier."""
    ts, parts, i = _c(ts), [], 0
    while i < len(fmt):
        if fmt[i] != "%":
            parts.append(F.lit(fmt[i]))
            i += 1
            continue
        f = fmt[i + 1 : i + 2]
        i += 2
        day = F.dayofweek(ts) - 1
        special = {
            "%": F.lit("%"),
            "w": day.cast("string"),
            "u": F.when(day == 0, 7).otherwise(day).cast("string"),
            "s": unix_epoch(ts).cast("string"),
            "f": F.date_format(ts, "ss.SSS"),
            "e": F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
            "k": F.lpad(F.hour(ts).cast("string"), 2, " "),
            "l": F.lpad(((F.hour(ts) + 11) % 12 + 1).cast("string"), 2, " "),
            "P": F.lower(F.date_format(ts, "a")),
            "V": F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
            "G": F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
            "g": F.lpad((F.extract(F.lit("YEAROFWEEK"), ts) % 100).cast("string"), 2, "0"),
            "U": F.lpad(F.floor((F.dayofyear(ts) + 6 - day) / 7).cast("string"), 2, "0"),
            "W": F.lpad(F.floor((F.dayofyear(ts) + 6 - (day + 6) % 7) / 7).cast("string"), 2, "0"),
        }
        if f == "J":
            raise ValueError("%J isn't in the dialect")
        if f in FORMATS:
            parts.append(F.date_format(ts, FORMATS[f]))
        elif f in special:
            parts.append(special[f])
        else:
            return F.lit(None).cast("string")
    return F.concat(*parts)


def modify(ts, *modifiers: str) -> Column:
    """Date modifiers in order: '+3 days', '-1 month', 'start of month', 'weekday 1', '+02:30'. Months that are too short
    run over ('ceiling', the default), or end on their last day before 'floor'."""
    import re

    ts = _c(ts).cast("timestamp_ntz")
    every = [m.strip().lower() for m in modifiers]
    for k, m in enumerate(every):
        if m in ("floor", "ceiling"):
            if not k or not re.fullmatch(r"[+-]?\d+ ?(month|year)s?", every[k - 1]):
                raise ValueError(f"{m} follows a step of months or years")
        elif x := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d))?", m):
            seconds = (int(x[2]) * 60 + int(x[3])) * 60 + int(x[4] or 0)
            ts = ts + F.make_dt_interval(secs=F.lit(-seconds if x[1] == "-" else seconds).cast("decimal(18,6)"))
        elif m.startswith("start of "):
            ts = F.date_trunc(m.removeprefix("start of "), ts).cast("timestamp_ntz")
        elif x := re.fullmatch(r"weekday ([0-6])", m):
            gap = (int(x[1]) - (F.dayofweek(ts) - 1) + 7) % 7
            ts = ts + F.make_dt_interval(days=gap)
        elif x := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) ?(second|minute|hour|day)s?", m):
            seconds = float(x[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[x[2]]
            ts = ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
        elif x := re.fullmatch(r"([+-]?\d+) ?(month|year)s?", m):
            months = int(x[1]) * (12 if x[2] == "year" else 1)
            if every[k + 1 : k + 2] == ["floor"]:
                ts = ts + F.make_ym_interval(months=F.lit(months))
                continue
            first = F.date_trunc("month", ts).cast("timestamp_ntz") + F.make_ym_interval(months=F.lit(months))
            ts = first + (ts - F.date_trunc("month", ts).cast("timestamp_ntz"))
        else:
            raise ValueError(f"unknown modifier: {m}")
    return ts
