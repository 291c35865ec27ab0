"""Time values against sqlite3, in a session of another zone as well."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialect
from tidemark.functions.timevalue import number_value, time_value

FORMS = [
    "2004-01-01", "2024-02-31", "2023-02-29", "2024-04-31", "2024-12-31 24:00", "2024-13-01", "2024-00-10", "2024-01-32", "2024-1-1", " 2024-01-01", "2024-01-01 ", "2024-01-01T", "2024-01-01T ",
    "2024-01-01T12:30", "2024-01-01 12:30:45", "2024-01-01  12:30:45.5", "2024-01-0112:30", "2024-01-01 12:60", "2024-01-01 25:00", "2024-01-01 12:30:60", "2024-01-01 12:3",
    "2024-01-01 12:30Z", "2024-01-01 12:30 z ", "2024-01-01 12:30+05:30", "2024-01-01 12:30:15-14:00", "2024-01-01 12:30+15:00", "2024-01-01 12:30+5:30", "2024-01-01 12:30:15.x", "2024-01-01 12:30.5",
    "2024-01-01 +02:00", "12:30", "23:59:59.999", "24:00", "12:30:45+01:00", "00:10+00:20", "12", "2460310.5", " 2460310.5 ", "+1e6", "-1", "0", "5373484.4", "5373484.5", "1e400", ".5", "5.", "1_0", "0x10", "abc", "", " ",
    "0000-01-01", "9999-12-31 23:59:59", "1582-10-10", "1900-02-29", "2000-02-30",
]
NUMBERS = [0, 1, 2460310.5, 2440587.5, 5373484.0, 5373485.0, -1.0, 1704067200, 1704067200.5, -210866760000, -210866760001, 253402300799, 253402300800, 1e18]


@pytest.fixture(scope="module")
def con():
    return sqlite3.connect(":memory:")


@pytest.mark.parametrize("mode", [None, "auto", "unixepoch"])
def test_texts(spark, con, mode):
    rng = random.Random(6)
    texts = FORMS + ["".join(rng.choice("0123456789-:T .Z+") for _ in range(rng.randrange(4, 20))) for _ in range(300)]
    more = [*([mode] if mode else []), "+0 days"]  # which makes days and hours run over
    want = [con.execute(f"SELECT strftime('%Y-%m-%d %H:%M:%f', ?{', ?' * len(more)})", (t, *more)).fetchone()[0] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", dialect.strftime("%F %H:%M:%f", time_value("t", mode)).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    # Years before 1582 are of another calendar in one of the two.
    assert [(t, w, got[i]) for i, (t, w) in enumerate(zip(texts, want)) if w != got[i] and not (w or "").startswith("-") and (w or "9") > "1583"] == []


@pytest.mark.parametrize("mode", [None, "auto", "unixepoch", "julianday"])
def test_numbers(spark, con, mode):
    more = [mode] if mode else []
    want = [con.execute(f"SELECT datetime(?{', ?' * len(more)})", (float(x), *more)).fetchone()[0] for x in NUMBERS]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(NUMBERS)], "i int, x double").select("i", dialect.strftime("%F %T", number_value("x", mode)).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    assert [(x, w, got[i]) for i, (x, w) in enumerate(zip(NUMBERS, want)) if w != got[i] and not (w or "").startswith("-") and (w or "9") > "1583"] == []
    with pytest.raises(ValueError):
        number_value("x", "localtime")


def test_other_zones(spark):
    """The results don't depend on the session's zone."""
    df = spark.createDataFrame([("2024-03-31 02:30:00",), ("1969-12-31 23:59:59.250",)], "t string")
    cols = [dialect.unix_epoch(time_value("t")).alias("u"), dialect.julian_day(time_value("t")).alias("j"), dialect.strftime("%s", time_value("t")).alias("s")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(*cols).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r.u, round(r.j, 6), r.s) for r in got] == [(1711852200, 2460400.604167, "1711852200"), (-1, 2440587.499991, "-1")]
    # A fraction never makes a second full; sqlite's versions differ here.
    assert df.select(dialect.strftime("%T", time_value(F.lit("2024-01-01 12:30:45.9999"))).alias("x")).first().x == "12:30:45"
    assert df.select((F.abs(dialect.unix_epoch(time_value(F.lit("now"))) - F.unix_timestamp()) < 100).alias("x")).first().x
