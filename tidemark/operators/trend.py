"""Trend statistics: intervals, growth tests, scores and states as Column expressions, and windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
Z = 1.959963984540054
ALPHA = 0.05
WEIGHTS = {"velocity": 0.30, "acceleration": 0.15, "persistence": 0.15, "source_diversity": 0.10, "platform_diversity": 0.10, "novelty": 0.10, "cross_platform_recurrence": 0.10}


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of k successes in n trials; null without trials."""
    ok = (n > 0) & (k <= n)
    p, z2 = k / n, Z * Z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1: Stirling's series at x + 8, and back."""
    y = x + 8.0
    back = x
    for i in range(1, 8):
        back = back * (x + float(i))
    u = 1.0 / (y * y)
    series = (1.0 / 12 - u * (1.0 / 360 - u * (1.0 / 1260 - u * (1.0 / 1680 - u / 1188)))) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(back)


#: Steps of the continued fraction at most: enough for a sum of both parameters of 10^6.
FRACTION = 400


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of a, b >= 1 and 0 <= x <= 1.

    By its continued fraction, evaluated from the front, on that side of the mean where it is quick. The steps it takes grow
    with the root of a + b, up to FRACTION.
    """
    near = x < (a + 1.0) / (a + b + 2.0)
    given = F.struct(F.when(near, a).otherwise(b).alias("p"), F.when(near, b).otherwise(a).alias("q"), F.when(near, x).otherwise(1.0 - x).alias("z"), near.alias("near"), (a + b).alias("sum"))
    away = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def whole(g: Column) -> Column:
        def step(s, i):
            # Places 1, 3, 5, ... are the even terms of the usual numbering, 2, 4, 6, ... its odd ones.
            m = F.floor((i + 1) / 2)
            even = m * (g["q"] - m) / ((g["p"] + 2 * m - 1) * (g["p"] + 2 * m))
            odd = -(g["p"] + m) * (g["sum"] + m) / ((g["p"] + 2 * m) * (g["p"] + 2 * m + 1))
            return turn(s, g["z"] * F.when(i % 2 == 1, even).otherwise(odd))

        def turn(s, term):
            d, c = 1.0 / away(1.0 + term * s["d"]), away(1.0 + term / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

        d0 = 1.0 / away(1.0 - g["sum"] * g["z"] / (g["p"] + 1.0))
        steps = (2 * F.least(F.lit(FRACTION), F.ceil(F.sqrt(g["sum"]) * 2) + 12)).cast("int")
        h = F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h")), step)["h"]
        front = F.exp(log_gamma(g["sum"]) - log_gamma(g["p"]) - log_gamma(g["q"]) + g["p"] * F.log(g["z"]) + g["q"] * F.log1p(-g["z"])) / g["p"]
        return F.when(g["z"] <= 0, 0.0).otherwise(front * h)

    # Bound once each, by a list of one: an expression that is used many times is a tree that grows.
    share = F.element_at(F.transform(F.array(given), lambda g: F.abs(F.when(g["near"], 0.0).otherwise(1.0) - whole(g))), 1)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def binomial_tails(n: Column, k: Column, p: Column) -> tuple[Column, Column]:
    """(P(X >= k), P(X <= k)) of a binomial of n trials, 0 <= k <= n: values of the incomplete beta function, at a bounded
    cost for every n."""
    n, k, p = n.cast("double"), k.cast("double"), p.cast("double")
    up = F.when(k <= 0, 1.0).otherwise(beta_share(F.greatest(k, F.lit(1.0)), n - k + 1.0, p))
    down = F.when(k >= n, 1.0).otherwise(beta_share(F.greatest(n - k, F.lit(1.0)), k + 1.0, 1.0 - p))
    return up, down


def rate_state(before: Column, before_seconds: Column, after: Column, after_seconds: Column) -> Column:
    """The exact conditional test of two Poisson rates, one-sided at ALPHA."""
    n = before + after
    rise, fall = binomial_tails(n, after, after_seconds / (before_seconds + after_seconds))
    state = F.when(n == 0, "NO_MENTIONS_IN_EITHER_WINDOW").when(rise < ALPHA, "RISING").when(fall < ALPHA, "FALLING").otherwise("NO_DETECTABLE_CHANGE")
    return F.when((before_seconds > 0) & (after_seconds > 0), state)


def saturated(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0)) / (1 + F.greatest(v, F.lit(0.0)))


def score(parts: dict[str, Column]) -> tuple[Column, Column]:
    """(score, coverage): weighted sum over the known parts, and the sum of their weights. Unknown parts are left out."""
    total, known = F.lit(0.0), F.lit(0.0)
    for name, part in parts.items():
        total = total + F.coalesce(F.lit(WEIGHTS[name]) * part, F.lit(0.0))
        known = known + F.when(part.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return total, known


def state(n: Column, velocity: Column, acceleration: Column, persistence: Column) -> Column:
    return (
        F.when(n < 2, "INSUFFICIENT_EVIDENCE")
        .when(acceleration > 0, "ACCELERATING")
        .when(velocity < 0, "COOLING")
        .when(persistence >= 0.75, "PERSISTENT")
        .when(velocity > 0, "EMERGING")
        .otherwise("DISCOVERED")
    )


def window_counts(events: DataFrame, key: list[str], seconds: str, width: int, now: int, windows: int) -> DataFrame:
    """Counts in (now - (k + 1) width, now - k width], k = 0 the latest: (key, k, n). Windows without events are absent."""
    k = F.floor((F.lit(now) - F.col(seconds)) / width).cast("int")
    return events.where((F.col(seconds) <= now) & (F.col(seconds) > now - width * windows)).groupBy(*key, k.alias("k")).agg(F.count("*").alias("n"))


def snapshots(counts: DataFrame, key: list[str], at: str, n: str) -> DataFrame:
    """Adds velocity (per hour), acceleration and persistence to counts by capture time in seconds."""
    w = Window.partitionBy(*key).orderBy(at)
    hours = (F.col(at) - F.lag(at).over(w)) / 3600
    v = counts.withColumn("velocity", (F.col(n) - F.lag(n).over(w)) / hours)
    v = v.withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / hours)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return v.withColumn("persistence", F.avg((F.col(n) > 0).cast("int")).over(before))


def shares_vs_prior(now: DataFrame, before: DataFrame, label: str) -> DataFrame:
    """(label, count, share, versus_prior): each label's share of the rows, and whether its 95 % interval lies apart from
    that of the rows before. Labels that only the rows before have are left out."""
    sides = now.select(F.col(label), F.lit(1).alias("new")).unionByName(before.select(F.col(label), F.lit(0).alias("new")))
    by = sides.groupBy(label).agg(F.sum("new").alias("k"), F.sum(1 - F.col("new")).alias("b"))
    every = by.agg(F.sum("k").alias("kn"), F.sum("b").alias("bn"))  # one row
    g = by.crossJoin(F.broadcast(every)).where("k > 0")
    lo, hi = wilson(F.col("k"), F.col("kn"))
    low, high = wilson(F.col("b"), F.col("bn"))
    state = F.when(lo.isNull() | low.isNull(), None).when(lo > high, "HIGHER").when(hi < low, "LOWER").otherwise("NOT_SEPARATED")
    return g.select(label, F.col("k").alias("count"), (F.col("k") / F.col("kn")).alias("share"), state.alias("versus_prior"))


def net_sentiment(positive: Column, negative: Column, labelled: Column) -> Column:
    """The share of positive rows less that of negative ones; null for fewer than three labelled."""
    return F.when(labelled >= 3, (positive - negative) / labelled)


def daily_growth(days: DataFrame, key: list[str], day: str, n: str) -> DataFrame:
    """(key, before, after, state) of the last three days (key, day, n) against the three before them, by the exact test.

    Only complete days belong in days; six that follow each other are needed.
    """
    r = days.withColumn("k_", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(day)))).where("k_ <= 6")
    sums = [F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).cast("long").alias(a) for c, a in ((F.col("k_") > 3, "before"), (F.col("k_") <= 3, "after"))]
    g = r.groupBy(*key).agg(*sums, ((F.count("*") == 6) & (F.datediff(F.max(day), F.min(day)) == 5)).alias("whole_"))
    three = F.lit(3 * 86_400)
    state = F.when(F.col("whole_"), rate_state(F.col("before"), three, F.col("after"), three)).otherwise("INSUFFICIENT_COMPLETE_DAYS")
    return g.select(*key, "before", "after", state.alias("state"))


def recurrence(rows: DataFrame, entity: str, platform: str, least: int = 2) -> DataFrame:
    """(entity, platforms, n): entities seen on at least `least` platforms, of which there are few."""
    g = rows.select(entity, platform).distinct().groupBy(entity).agg(F.array_join(F.array_sort(F.collect_list(platform)), ",").alias("platforms"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)


def evidence_grade(sources: DataFrame, key: list[str], state: str) -> DataFrame:
    """(key, grade): complete if all sources are, interrupted if the network broke off any of them, else partial."""
    s = F.col(state)
    grade = F.when(F.bool_and(F.coalesce(s == "COMPLETE_BY_SOURCE", F.lit(False))), "COMPLETE_BY_SOURCE").when(F.bool_or(s == "NETWORK_INTERRUPTED"), "INTERRUPTED").otherwise("PARTIAL")
    return sources.groupBy(*key).agg(grade.alias("grade"))


def decay(age: Column, half_life: Column) -> Column:
    """2 to the power of -age / half_life; null without a half-life."""
    return F.when(half_life > 0, F.pow(F.lit(2.0), -age / half_life))


# Seconds of the narrowest slice, and the most slices of a window.
LEAST_SLICE, MOST_SLICES = 3_600, 31


def fitted_width(start: Column, end: Column, width: Column, affordable: Column) -> Column:
    """The narrowest width, at least the one asked for, whose slices cover the window in as many as are affordable."""
    slots = F.least(F.greatest(affordable, F.lit(1)), F.lit(MOST_SLICES))
    return F.greatest(width, F.lit(LEAST_SLICE), F.ceil(F.greatest(end - start, F.lit(0)) / slots)).cast("long")


def slices(start: Column, end: Column, width: Column) -> Column:
    """array of struct(since, until), each (since, until], newest first; the oldest may be shorter. At most MOST_SLICES:
    what is older is never planned."""
    w = F.greatest(width, F.lit(LEAST_SLICE)).cast("long")
    n = F.least(F.ceil((end - start) / w), F.lit(MOST_SLICES)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.greatest(start, end - (i + 1) * w).alias("since"), (end - i * w).alias("until")))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(F.struct(start.alias("since"), end.alias("until"))), 1, 0))
