"""Displayed counts and ages as bounds: "1.2万" and "3k+" say a range, not a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Multipliers of suffixes, as written.
SUFFIXES = {"万": 10**4, "萬": 10**4, "w": 10**4, "W": 10**4, "亿": 10**8, "億": 10**8, "千": 10**3, "k": 10**3, "K": 10**3, "M": 10**6, "B": 10**9}
#: Seconds of units before 前, and of English units before "ago".
BEFORE = {"秒钟": 1, "秒": 1, "分钟": 60, "分鐘": 60, "分": 60, "个小时": 3600, "個小時": 3600, "小时": 3600, "小時": 3600, "天": 86400, "日": 86400, "周": 604800, "週": 604800, "星期": 604800}
UNIT_SECONDS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _lookup(key: Column, values: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.lit(v).cast("long"))]), key)


def count_bounds(text) -> Column:
    """struct(nominal, lower, upper) of a displayed count; null for anything else. A '+' has no upper bound.

    The last shown digit is uncertain: half a step below, and up to a step less one above. Thousands may be grouped
    where there is no suffix; a number may have as many decimals as its suffix has zeros.
    """
    x = F.btrim(_c(text))
    plus = x.endswith("+")
    body = F.when(plus, F.rtrim(x.substr(F.lit(1), F.char_length(x) - 1))).otherwise(x)
    scaled = rf"^([0-9]+)(?:\.([0-9]+))?\s*({'|'.join(SUFFIXES)})$"
    bare = r"^([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)$"
    # Each stage is bound, so that its expressions are matched once a text and not wherever they are named.
    given = F.struct(plus.alias("plus"), body.alias("body"))
    read = lambda g: F.struct(
        g["plus"].alias("plus"),
        F.coalesce(F.nullif(F.regexp_extract(g["body"], scaled, 1), F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(g["body"], bare, 1), ",", ""), F.lit(""))).try_cast("long").alias("whole"),
        F.regexp_extract(g["body"], scaled, 2).alias("part"),
        F.coalesce(_lookup(F.regexp_extract(g["body"], scaled, 3), SUFFIXES), F.lit(1).cast("long")).alias("times"),
    )

    def stepped(r: Column) -> Column:
        scale = F.pow(F.lit(10.0), F.length(r["part"])).cast("long")
        return F.struct(r.alias("r"), F.when(r["times"] % scale == 0, F.expr("1") * (r["times"] / scale).cast("long")).alias("step"))

    def named(s: Column) -> Column:
        r = s["r"]
        return F.struct(r["plus"].alias("plus"), s["step"].alias("step"), F.try_add(F.try_multiply(r["whole"], r["times"]), F.coalesce(r["part"].try_cast("long"), F.lit(0).cast("long")) * s["step"]).alias("nominal"))

    def bounds(b: Column) -> Column:
        plus, step, nominal = b["plus"], b["step"], b["nominal"]
        lower = F.when(plus, nominal).otherwise(nominal - F.floor(step / 2).cast("long"))
        upper = F.when(~plus, F.try_add(nominal, step - 1))
        return F.when(step.isNotNull() & nominal.isNotNull(), F.struct(nominal.alias("nominal"), F.greatest(lower, F.lit(0).cast("long")).alias("lower"), upper.alias("upper")))

    return bound(bound(bound(bound(given, read), stepped), named), bounds)


def age_window(text, captured: Column) -> Column:
    """struct(earliest, latest) in seconds of a relative age ("3分钟前", "3 hours ago") seen at captured; null for anything else.

    An age before 前 may be rounded up by half a unit; an English one is rounded down.
    """
    x = F.btrim(_c(text))
    cjk = rf"^([0-9]+)\s*({'|'.join(BEFORE)})\s*前$"
    n, seconds = F.regexp_extract(x, cjk, 1).try_cast("long"), _lookup(F.regexp_extract(x, cjk, 2), BEFORE)
    english = r"^([0-9]+)\s*([a-z]+?)s?(?:\s+ago)?$"
    m, unit = F.regexp_extract(F.lower(x), english, 1).try_cast("long"), _lookup(F.regexp_extract(F.lower(x), english, 2), UNIT_SECONDS)
    span = lambda early, late: F.struct(F.greatest(F.lit(0), early).cast("long").alias("earliest"), F.greatest(F.lit(0), late).cast("long").alias("latest"))
    return F.when(seconds.isNotNull(), span(captured - (n + 1) * seconds, captured - n * seconds + F.floor(seconds / 2))).when(unit.isNotNull(), span(captured - (m + 1) * unit, captured - m * unit))
