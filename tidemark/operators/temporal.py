"""Step series, validity windows and time-weighted statistics.

A step series is rows (key, ts, value): each value holds until the next row's time; null is an unavailable span.
Times are seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_spans(series: DataFrame, key: list[str], ts: str, value: str, as_of: Column) -> DataFrame:
    """(key, start, end, value): each point until the next, or as_of; spans of no length are left out."""
    end = F.least(F.coalesce(F.lead(ts).over(Window.partitionBy(*key).orderBy(ts)), as_of), as_of)
    spans = series.select(*key, F.col(ts).alias("start"), end.alias("end"), F.col(value).alias("value"))
    return spans.where(F.col("end") > F.col("start"))


def clip(spans: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The parts of spans within [lo, hi]."""
    return spans.withColumns({"start": F.greatest("start", lo), "end": F.least("end", hi)}).where(F.col("end") > F.col("start"))


def weighted_quantiles(spans: DataFrame, key: list[str], qs: dict[str, float]) -> DataFrame:
    """For each key, the first value by size at which the seconds so far reach q of all. Null values don't count.

    Spans of one value are summed first, so the window sorts distinct values.
    """
    w = spans.where(F.col("value").isNotNull()).groupBy(*key, "value").agg(F.sum(F.col("end") - F.col("start")).alias("w"))
    over = Window.partitionBy(*key)
    cum = w.withColumns({"cum": F.sum("w").over(over.orderBy("value")), "all": F.sum("w").over(over)})
    return cum.groupBy(*key).agg(*[F.min(F.when(F.col("cum") >= q * F.col("all"), F.col("value"))).alias(n) for n, q in qs.items()], F.sum("w").alias("seconds"))


def discounts(series: DataFrame, key: list[str], ts: str, value: str, bps: int = 500) -> DataFrame:
    """(key, ts, before, after): drops of at least bps against the last available value."""
    prev = F.lag(value).over(Window.partitionBy(*key).orderBy(ts))
    pairs = series.where(F.col(value).isNotNull()).select(*key, F.col(ts).alias("ts"), prev.alias("before"), F.col(value).alias("after"))
    return pairs.where((F.col("after") - F.col("before")) * 10000 <= -bps * F.col("before"))


#: Seconds of a bucket: the rows of a key that one task scans begin within so many seconds.
BUCKET = 86_400


def union_coverage(spans: DataFrame, key: list[str], start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """Seconds that at least one span covers, and the number of gaps between them, by key.

    A scan in two levels: each bucket of starts begins with the latest end of the buckets before it, so a key's spans
    are scanned by as many tasks as it has buckets. Spans without a start or an end are left out.
    """
    of = Window.partitionBy(*key, "bucket_")
    s = spans.select(*key, F.col(start).alias("lo_"), F.col(end).alias("hi_")).where("lo_ IS NOT NULL AND hi_ IS NOT NULL").withColumn("bucket_", F.floor(F.col("lo_") / bucket))
    ends = s.groupBy(*key, "bucket_").agg(F.max("hi_").alias("hi_"))
    before = F.max("hi_").over(Window.partitionBy(*key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*key, "bucket_", before.alias("hi_")).where("hi_ IS NOT NULL").select(*key, F.lit(None).cast(s.schema["lo_"].dataType).alias("lo_"), "hi_", "bucket_")
    seen = F.max("hi_").over(of.orderBy(F.asc_nulls_first("lo_"), "hi_").rowsBetween(Window.unboundedPreceding, -1))
    parts = s.unionByName(carried).withColumn("seen_", seen).where("lo_ IS NOT NULL")
    new = F.greatest(F.lit(0), F.col("hi_") - F.greatest(F.col("lo_"), F.coalesce("seen_", "lo_")))
    return parts.groupBy(*key).agg(F.sum(new).cast("long").alias("covered"), F.count_if(F.col("lo_") > F.col("seen_")).alias("gaps"))


def scd2(observations: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """Validity windows (key, value, valid_at, invalid_at, last_observed_at) from observations in time order.

    A null observation changes nothing; a repeated value extends last_observed_at; another closes the window.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    seen = observations.where(F.col(value).isNotNull())
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = seen.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    windows = runs.groupBy(*key, "run").agg(F.first(value).alias("value"), F.min(ts).alias("valid_at"), F.max(ts).alias("last_observed_at"))
    end = F.lead("valid_at").over(Window.partitionBy(*key).orderBy("valid_at"))
    return windows.select(*key, "value", "valid_at", end.alias("invalid_at"), "last_observed_at")


def as_of(windows: DataFrame, questions: DataFrame, key: list[str], at: str, bucket: int = BUCKET) -> DataFrame:
    """Each question (key, at) with what was known: value and state.

    CONFLICT: several values cover the time. OBSERVED: covered, and seen at or after it. NOT_OBSERVED_SINCE: the window
    is open, but was last seen earlier. CHANGE_TIME_UNKNOWN: closed, but not seen up to then. UNKNOWN: none covers it.

    Windows and questions are one series in the order of their times, and a question reads what the windows begun before
    it come to: the latest end and its value, the latest end of any other value (of two windows of different values, the
    one that ends first), and the latest time seen. All are maxima, so a key is scanned in buckets of time, each of which
    begins with the maxima of those before: no windows meet questions one by one. Times are numbers; a null value counts
    as no window, a repeated question is answered once.
    """
    forever = F.lit(float("inf"))
    w = windows.where(F.col("value").isNotNull() & F.col("valid_at").isNotNull())
    until, seen = F.coalesce(F.col("invalid_at").cast("double"), forever), F.coalesce("last_observed_at", "valid_at").cast("double")
    # Seen at the end or later is seen up to the end, which is outside of the window.
    shown = F.when(seen < until, F.struct(seen.alias("t"), F.lit(1).alias("in"))).otherwise(F.struct(until.alias("t"), F.lit(0).alias("in")))
    rows = w.where(until > F.col("valid_at")).select(*key, F.col("valid_at").cast("double").alias("t_"), F.lit(1).alias("kind_"), F.struct(until.alias("end"), F.col("value").alias("value")).alias("top_"), F.lit(None).cast("double").alias("low_"), shown.alias("shown_"))
    asked = questions.select(*key, at).distinct()
    rows = rows.withColumn("bucket_", F.floor(F.col("t_") / bucket))

    def scanned(r: DataFrame, order: list[Column], part: list[str]) -> DataFrame:
        upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        was = F.max("top_").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        r = r.withColumn("was_", was)
        beaten = F.when(F.col("was_.value") != F.col("top_.value"), F.least("was_.end", "top_.end"))
        r = r.withColumn("low_", F.greatest("low_", beaten))
        return r.withColumns({"low_": F.max("low_").over(upto), "shown_": F.max("shown_").over(upto), "top_": F.max("top_").over(upto)}).drop("was_")

    # What the buckets come to: their rows by value, scanned in any order within a bucket.
    sums = rows.groupBy(*key, "bucket_", F.col("top_.value").alias("v_")).agg(F.max("top_").alias("top_"), F.max("low_").alias("low_"), F.max("shown_").alias("shown_"))
    all_ = scanned(sums, [F.asc("bucket_"), F.asc("v_")], key).withColumn("last_", F.row_number().over(Window.partitionBy(*key, "bucket_").orderBy(F.desc("v_")))).where("last_ = 1")
    q = asked.withColumn("bucket_", F.floor(F.col(at) / bucket))
    needed = rows.select(*key, "bucket_").union(q.select(*key, "bucket_")).distinct()
    upto = Window.partitionBy(*key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    state = needed.join(all_.select(*key, "bucket_", F.struct("top_", "low_", "shown_").alias("s_")), [*key, "bucket_"], "left")
    carried = state.withColumn("s_", F.last("s_", ignorenulls=True).over(upto)).where("s_ IS NOT NULL")
    first = carried.select(*key, F.lit(float("-inf")).alias("t_"), F.lit(0).alias("kind_"), "s_.top_", "s_.low_", "s_.shown_", "bucket_")
    q = q.select(*key, F.col(at).cast("double").alias("t_"), F.lit(2).alias("kind_"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("top_", "low_", "shown_")], "bucket_", F.col(at).alias("at_"))
    series = rows.unionByName(first).withColumn("at_", F.lit(None).cast(asked.schema[at].dataType)).unionByName(q)
    a = scanned(series, [F.asc("t_"), F.asc("kind_")], [*key, "bucket_"]).where("kind_ = 2")
    covered, t = F.coalesce(F.col("top_.end") > F.col("t_"), F.lit(False)), F.col("t_")
    conflict = F.coalesce(F.col("low_") > t, F.lit(False))
    in_sight = (t < F.col("shown_.t")) | ((t == F.col("shown_.t")) & (F.col("shown_.in") == 1))
    state = F.when(conflict, "CONFLICT").when(~covered, "UNKNOWN").when(in_sight, "OBSERVED").when(F.col("top_.end") == forever, "NOT_OBSERVED_SINCE").otherwise("CHANGE_TIME_UNKNOWN")
    return a.select(*key, F.col("at_").alias(at), F.when(covered & ~conflict, F.col("top_.value")).alias("value"), state.alias("state"))


def supersede(windows: DataFrame, key: list[str]) -> DataFrame:
    """Overlapping older windows end where the next later one starts; windows of equal start stay as they are."""
    later = F.min("valid_at").over(Window.partitionBy(*key).orderBy("valid_at").rangeBetween(1, Window.unboundedFollowing))
    cut = F.when(later < F.coalesce(F.col("invalid_at"), later + 1), later).otherwise(F.col("invalid_at"))
    return windows.withColumn("invalid_at", cut)


def carry_forward(observations: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """Adds carried, the last value seen so far, and unobserved_since, the start of the present gap."""
    w = Window.partitionBy(*key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col(value).isNotNull(), F.col(ts)), ignorenulls=True).over(w)
    gaps = observations.withColumns({"carried": F.last(value, ignorenulls=True).over(w), "seen_at": seen})
    first_gap = F.min(F.when(F.col(value).isNull(), F.col(ts))).over(Window.partitionBy(*key, "seen_at").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    return gaps.withColumn("unobserved_since", F.when(F.col(value).isNull(), first_gap)).drop("seen_at")


def daily_samples(spans: DataFrame, key: list[str], as_of: Column, days: int) -> DataFrame:
    """The value in force at each day's end: (key, day, at, value)."""
    at = as_of - F.col("day") * 86400 - 1
    grid = spans.select(*key, "start", "end", "value", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("day")).withColumn("at", at)
    return grid.where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end"))).select(*key, "day", "at", "value")


def rank_velocity(samples: DataFrame, key: list[str]) -> DataFrame:
    """From daily samples of positive ranks: the slope of log rank per day, and the deviation of its one-day changes."""
    s = samples.where("value > 0").withColumn("ln", F.log("value"))
    w = Window.partitionBy(*key).orderBy("at")
    s = s.withColumns({"step": F.when(F.col("at") - F.lag("at").over(w) == 86400, F.col("ln") - F.lag("ln").over(w))})
    ends = s.groupBy(*key).agg(F.min_by("ln", "at").alias("a"), F.max_by("ln", "at").alias("b"), ((F.max("at") - F.min("at")) / 86400).alias("d"), F.stddev_samp("step").alias("volatility"), F.count("*").alias("n"))
    v = F.when(F.col("d") > 0, (F.col("b") - F.col("a")) / F.col("d"))
    way = F.when(v.isNull(), "UNKNOWN").when(v < -0.005, "IMPROVING").when(v > 0.005, "DECLINING").otherwise("STABLE")
    return ends.select(*key, "n", v.alias("velocity"), "volatility", way.alias("direction"))


def rank_persistence(present: DataFrame, key: str, capture: str) -> DataFrame:
    """For each key in the latest capture: captures since its first, re-entries, current streak and state.

    present: one row (key, capture number) for each capture that lists the key; captures are numbered without gaps.
    """
    last = present.agg(F.max(capture).alias("last_capture"))
    w = Window.partitionBy(key).orderBy(capture)
    runs = present.select(key, capture).distinct().withColumn("run", F.col(capture) - F.row_number().over(w))
    by = runs.groupBy(key, "run").agg(F.min(capture).alias("lo"), F.max(capture).alias("hi"))
    k = by.groupBy(key).agg(F.min("lo").alias("first"), F.max("hi").alias("hi"), (F.count("*") - 1).alias("re_entries"), F.max_by(F.col("hi") - F.col("lo") + 1, "hi").alias("streak"))
    k = k.crossJoin(F.broadcast(last)).where("hi = last_capture")
    state = F.when(F.col("first") == F.col("last_capture"), "NEW_ON_LIST").when((F.col("re_entries") > 0) & (F.col("streak") == 1), "RE_ENTERED").otherwise("SUSTAINED")
    return k.select(key, (F.col("last_capture") - F.col("first") + 1).alias("captures"), "re_entries", "streak", state.alias("state"))


def edge_triggered(observations: DataFrame, key: list[str], ts: str, met: Column) -> DataFrame:
    """The rows at which a condition holds that didn't hold at the row before."""
    w = Window.partitionBy(*key).orderBy(ts)
    return observations.withColumn("met_", met).withColumn("was_", F.lag("met_").over(w)).where(F.col("met_") & ~F.coalesce("was_", F.lit(False))).drop("met_", "was_")


def observed_statistics(windows: DataFrame, key: list[str]) -> DataFrame:
    """Of SCD2 windows (value, valid_at, last_observed_at), by key: low, quartiles and high by observed seconds, the
    latest value, and the share of time below it in basis points. Windows without length don't weigh."""
    seen = F.greatest(F.coalesce("last_observed_at", "valid_at"), "valid_at")
    spans = windows.select(*key, "value", F.col("valid_at").alias("start"), seen.alias("end"))
    last = spans.groupBy(*key).agg(F.max_by("value", "start").alias("latest"))
    q = weighted_quantiles(spans.where(F.col("end") > F.col("start")), key, {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "high": 1.0})
    below = spans.join(last, key).groupBy(*key, "latest").agg(F.sum(F.when(F.col("value") < F.col("latest"), F.col("end") - F.col("start")).otherwise(0)).alias("below"))
    return below.join(q, key).select(*key, "low", "p25", "median", "p75", "high", "latest", "seconds", F.floor(F.col("below") * 10000 / F.col("seconds")).alias("share_below_latest_bps"))


def changes(snapshots: DataFrame, key: list[str], at: str, fields: list[str]) -> DataFrame:
    """(key, at, field, before, after, across_gap): a field that differs from the last time it was known.

    A field that isn't observed keeps what was known; a change over such a gap is marked.
    """
    w = Window.partitionBy(*key).orderBy(at)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = []
    for f in fields:
        known = F.last(f, ignorenulls=True).over(before)
        rows.append(F.struct(F.lit(f).alias("field"), known.cast("string").alias("before"), F.col(f).cast("string").alias("after"), F.lag(f).over(w).isNull().alias("across_gap")))
    out = snapshots.select(*key, at, F.array(*rows).alias("r")).select(*key, at, F.explode("r").alias("c")).select(*key, at, "c.*")
    return out.where("before IS NOT NULL AND after IS NOT NULL AND before <> after")
