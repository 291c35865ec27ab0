"""Statistics of prices: summaries of stated ones, histories of step series, and observed spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal

DAY = 86_400
#: A discount in basis points, and the days that a window must have been known for.
DISCOUNT_BPS, LEAST_DAYS = 500, 7


def lower_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the middle value, the lower of two. Equal values are counted first; nothing holds a group."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("w"))
    over = Window.partitionBy(*keys)
    cum = n.withColumns({"cum": F.sum("w").over(over.orderBy("value")), "all": F.sum("w").over(over)})
    return cum.where(2 * F.col("cum") >= F.col("all")).groupBy(*keys).agg(F.min("value").alias(name))


def price_summary(prices: DataFrame, keys: list[str], price: str, day: str, discounted: Column, distinct: dict[str, str]) -> DataFrame:
    """By keys (a currency and a unit, which are never mixed): prices, discounted ones, range, lower median, days from
    and to, and how many different values stand behind each of distinct (result name to column)."""
    figures = [F.count("*").alias("prices"), F.count_if(discounted).alias("discounted"), F.min(price).alias("min"), F.max(price).alias("max")]
    figures += [F.min(day).alias("earliest"), F.max(day).alias("latest")]
    figures += [F.count_distinct(c).alias(n) for n, c in distinct.items()]
    middle = lower_median(prices, keys, price, "median")
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    return prices.groupBy(*keys).agg(*figures).alias("g").join(middle.alias("m"), same, "left").select("g.*", "m.median")


def _median_within(spans: DataFrame, key: list[str], lo: Column, hi: Column, name: str) -> DataFrame:
    """(key, name): the time-weighted median within [lo, hi], where at least LEAST_DAYS of it are known."""
    q = temporal.weighted_quantiles(temporal.clip(spans, lo, hi), key, {name: 0.5})
    return q.where(F.col("seconds") >= LEAST_DAYS * DAY).select(*key, name)


def price_history(series: DataFrame, key: list[str], ts: str, value: str, as_of: Column, window_days: int = 90) -> DataFrame:
    """By key, of a step series up to as_of: points, span_seconds, unavailable_share, low, p25, median, p75, high, latest,
    cv_bps, discounts, trend_bps and trend_status. Keys without a span of any length aren't listed.

    Values weigh by the time they hold; nulls are unavailable. A discount is a drop of at least DISCOUNT_BPS against the
    last known value. The trend compares the medians of the last window_days and of as many before.
    """
    spans = temporal.step_spans(series, key, ts, value, as_of)
    w = (F.col("end") - F.col("start")).cast("double")
    have = F.col("value").isNotNull()
    known, v = F.sum(F.when(have, w)), F.col("value").cast("double")
    base = spans.groupBy(*key).agg(F.min("start").alias("first"), (as_of - F.min("start")).alias("span_seconds"), F.coalesce(known, F.lit(0.0)).alias("known"), (F.sum(v * w) / known).alias("mean"))
    # Deviations from the mean, not squares less its square, so that nothing cancels out.
    off = spans.join(base.select(*key, "mean"), key).where(have).groupBy(*key).agg(F.sqrt(F.sum((v - F.col("mean")) ** 2 * w) / F.sum(w)).alias("sd"), F.max("value").alias("high"))
    points = series.groupBy(*key).agg(F.count("*").alias("points"), F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias("latest"))
    drops = temporal.discounts(series, key, ts, value, DISCOUNT_BPS).where("before > 0").groupBy(*key).agg(F.count("*").alias("discounts"))
    q = temporal.weighted_quantiles(spans, key, {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75}).drop("seconds")
    recent = _median_within(spans, key, as_of - window_days * DAY, as_of, "recent")
    prior = _median_within(spans, key, as_of - 2 * window_days * DAY, as_of - window_days * DAY, "prior")
    out = base
    for part in (off, points, drops, q, recent, prior):
        out = out.join(part, key, "left")
    trend = F.when(F.col("prior") > 0, ((F.col("recent") - F.col("prior")) * 10_000 / F.col("prior")).cast("long"))
    return out.select(
        *key,
        "points",
        "span_seconds",
        F.when(F.col("span_seconds") > 0, 1 - F.col("known") / F.col("span_seconds")).otherwise(0.0).alias("unavailable_share"),
        *["low", "p25", "median", "p75", "high", "latest"],
        F.when(F.col("mean") > 0, F.round(F.col("sd") / F.col("mean") * 10_000).cast("long")).alias("cv_bps"),
        F.coalesce("discounts", F.lit(0)).cast("long").alias("discounts"),
        trend.alias("trend_bps"),
        F.when(trend.isNotNull(), "DERIVED").otherwise("INSUFFICIENT_COVERAGE_7_DAYS_PER_WINDOW").alias("trend_status"),
    )


def observed_prices(windows: DataFrame, key: list[str], currencies: DataFrame | None = None) -> DataFrame:
    """By key, of price windows (value, valid_at, last_observed_at): state, reason, observed_seconds, unobserved_seconds
    and the figures of temporal.observed_statistics(), which are null unless the state is DERIVED.

    CONFLICT: a window begins before another of a different value was last seen, or currencies (key, currency) has
    several for the key. INSUFFICIENT_DURATION: no window has a length. A window ends when it was last seen.
    """
    seen = F.greatest(F.coalesce("last_observed_at", "valid_at"), "valid_at")
    w = windows.withColumn("seen_", seen)
    order = Window.partitionBy(*key).orderBy("valid_at", "value", "seen_")
    overlap = (F.col("valid_at") < F.lag("seen_").over(order)) & (F.col("value") != F.lag("value").over(order))
    g = w.withColumn("overlap_", F.coalesce(overlap, F.lit(False))).groupBy(*key).agg(F.bool_or("overlap_").alias("overlap_"), F.sum(F.col("seen_") - F.col("valid_at")).alias("observed_seconds"), (F.max("seen_") - F.min("valid_at")).alias("span_"))
    if currencies is None:
        g = g.withColumn("mixed_", F.lit(False))
    else:
        mixed = currencies.groupBy(*key).agg((F.count_distinct("currency") > 1).alias("mixed_"))
        g = g.join(mixed, key, "left").withColumn("mixed_", F.coalesce("mixed_", F.lit(False)))
    reason = F.when(F.col("overlap_"), "OVERLAPPING_PRICE_WINDOWS").when(F.col("mixed_"), "MORE_THAN_ONE_CURRENCY")
    state = F.when(reason.isNotNull(), "CONFLICT").when(F.col("observed_seconds") == 0, "INSUFFICIENT_DURATION").otherwise("DERIVED")
    g = g.select(*key, state.alias("state"), reason.alias("reason"), "observed_seconds", F.greatest(F.lit(0), F.col("span_") - F.col("observed_seconds")).alias("unobserved_seconds"))
    figures = temporal.observed_statistics(windows, key).drop("seconds")
    names = [c for c in figures.columns if c not in key]
    return g.join(figures, key, "left").select(*key, "state", "reason", "observed_seconds", "unobserved_seconds", *[F.when(F.col("state") == "DERIVED", F.col(n)).alias(n) for n in names])
