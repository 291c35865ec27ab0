"""As-of answers, coverage and binomial tails against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, temporal, trend

WINDOWS = "k string, value string, valid_at long, invalid_at long, last_observed_at long"


def answer(windows, k, at):
    cover = [w for w in windows if w[0] == k and w[1] is not None and w[2] <= at and (w[3] is None or at < w[3])]
    values = {w[1] for w in cover}
    if len(values) > 1:
        return None, "CONFLICT"
    if not values:
        return None, "UNKNOWN"
    if at <= max(w[4] if w[4] is not None else w[2] for w in cover):
        return values.pop(), "OBSERVED"
    return values.pop(), "NOT_OBSERVED_SINCE" if any(w[3] is None for w in cover) else "CHANGE_TIME_UNKNOWN"


@pytest.mark.parametrize("bucket", [1, 7, 86_400])
def test_as_of_is_brute_force(spark, bucket):
    rng = random.Random(bucket)
    windows = []
    for k in "abc":
        for _ in range(40):
            lo = rng.randrange(100)
            hi = rng.choice([None, lo, lo + rng.randrange(1, 12), lo + rng.randrange(1, 12), lo + rng.randrange(1, 12)]) if rng.random() < 0.9 else lo + 50
            if hi is None and rng.random() < 0.7:
                hi = lo + 3
            windows.append((k, rng.choice(["x", "y", "z", None]), lo, hi, rng.choice([None, lo, lo + 1, lo + rng.randrange(15)])))
    asked = [(k, t) for k in "abcd" for t in range(-1, 130, 1)] * 2
    got = temporal.as_of(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(asked, "k string, at long"), ["k"], "at", bucket)
    rows = got.collect()
    assert {(r.k, r["at"]): (r.value, r.state) for r in rows} == {(k, t): answer(windows, k, t) for k, t in asked}
    assert len(rows) == len(set(asked)) and len({r.state for r in rows}) == 5


def test_as_of_without_windows_or_questions(spark):
    w, q = spark.createDataFrame([("a", "x", 1, None, None)], WINDOWS), spark.createDataFrame([("a", 5)], "k string, at long")
    assert [tuple(r) for r in temporal.as_of(w.limit(0), q, ["k"], "at").collect()] == [("a", 5, None, "UNKNOWN")]
    assert temporal.as_of(w, q.limit(0), ["k"], "at").count() == 0


def test_as_of_windows_dont_meet_questions(spark):
    """One key with 3 000 windows and 3 000 questions: no join by key alone, and no task with all rows of the key."""
    w = spark.range(3000).selectExpr("'a' AS k", "concat('v', id) AS value", "id * 10 AS valid_at", "id * 10 + 10 AS invalid_at", "id * 10 + 4 AS last_observed_at")
    q = spark.range(3000).selectExpr("'a' AS k", "id * 10 + id % 10 AS at")
    got = temporal.as_of(w, q, ["k"], "at", 100)
    assert {r.state: r.n for r in got.groupBy("state").agg(F.count("*").alias("n")).collect()} == {"OBSERVED": 1500, "CHANGE_TIME_UNKNOWN": 1500}
    assert got.where("value <> concat('v', floor(at / 10))").count() == 0


@pytest.mark.parametrize("bucket", [3, 50, 86_400])
def test_coverage_is_brute_force(spark, bucket):
    rng = random.Random(bucket)
    spans = [(k, lo, lo + rng.choice([0, 1, 3, 40])) for k in "ab" for lo in (rng.randrange(-200, 800) for _ in range(60))]
    got = {r.k: (r.covered, r.gaps) for r in temporal.union_coverage(spark.createDataFrame([*spans, ("a", None, 5), ("a", 5, None)], "k string, lo long, hi long"), ["k"], "lo", "hi", bucket).collect()}
    for k in "ab":
        own = sorted((lo, hi) for x, lo, hi in spans if x == k)
        seconds = len({t for lo, hi in own for t in range(lo, hi)})
        ends, gaps = own[0][1], 0
        for lo, hi in own[1:]:
            gaps += lo > ends
            ends = max(ends, hi)
        assert got[k] == (seconds, gaps)


def exact(n, k, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)]
    return math.fsum(map(math.exp, logs[k:])), math.fsum(map(math.exp, logs[: k + 1]))


def test_binomial_tails(spark):
    cases = [(n, k, p) for n in (0, 1, 2, 5, 40, 999) for k in sorted({0, n // 3, n // 2, max(0, n - 1), n}) for p in (0.5, 0.1, 0.93)]
    cases += [(100_000, k, 0.5) for k in (49_000, 50_000, 50_100, 50_260, 51_000)] + [(100_000, 30_100, 0.3), (20_000, 40, 0.002)]
    df = spark.createDataFrame(cases, "n long, k long, p double").repartition(4)
    up, down = trend.binomial_tails(F.col("n"), F.col("k"), F.col("p"))
    for r in df.select("n", "k", "p", up.alias("up"), down.alias("down")).collect():
        a, b = exact(r.n, r.k, r.p)
        assert abs(r.up - a) < 1e-9 and abs(r.down - b) < 1e-9, r
    huge = spark.createDataFrame([(1_000_000, 500_000, 0.5)], "n long, k long, p double").select(up.alias("up"), down.alias("down")).first()
    assert abs(huge.up + huge.down - 1 - 0.0007978845) < 1e-8


@pytest.mark.parametrize("bins", [64, 1024])
def test_quantiles_are_exact(spark, bins):
    """Also of values over many magnitudes, of ties, and of a group with one value."""
    rng = random.Random(bins)
    groups = {"even": [rng.random() for _ in range(501)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-12, 12) for _ in range(200)], "ties": [float(rng.randrange(3)) for _ in range(100)], "one": [4.5], "ends": [-1.7e308, 1.7e308]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("none", None)], "k string, v double").repartition(4)
    wanted = spark.createDataFrame([(k, r) for k in (*groups, "none") for r in (0, 1, 3, 50, 99, 100, 250, 499, -1)], "k string, rank long")
    got = {(r.k, r["rank"]): r.value for r in ranking.order_statistics(df, ["k"], "v", wanted, bins).collect()}
    assert got == {(k, r): sorted(vs)[r] for k, vs in groups.items() for r in (0, 1, 3, 50, 99, 100, 250, 499) if r < len(vs)}
    if bins > 64:
        q = {r.k: (r.a, r.b) for r in ranking.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
        assert q["one"] == (4.5, 4.5) and q["even"][0] == sorted(groups["even"])[250] and set(q) == set(groups)
        assert math.isclose(q["even"][1], sorted(groups["even"])[450], rel_tol=1e-12)
