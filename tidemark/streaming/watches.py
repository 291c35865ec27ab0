"""Watches: leases that fence workers, results that are committed once, and the versions that follow from them.

The log has a row for each attempt: CLAIM (a worker asks for a watch under a token of its own), FINISH (it hands in a
result under that token; `ok` tells whether it has one), ENABLE and DISABLE. A watch's state is kept by the stream, so
each attempt is judged once, in the log's order, whatever runs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.temporal import scd2

from .publish import Published

#: Fixed value: seconds of a lease.
LEASE = 180
LOG = "watch_id long, seq long, at long, kind string, token long, ok boolean, value double"
OUTCOME = "watch_id long, seq long, at long, kind string, token long, ok boolean, value double, outcome string, version long"


@dataclass
class Watch:
    """What a watch is now: its holder's token (-1: none) and until when, when it is due, how many results it has taken,
    and the last attempt that was judged."""

    token: int = -1
    lease_until: int = 0
    next_due: int = 0
    version: int = 0
    enabled: bool = True
    at: int = -(1 << 62)
    seq: int = -(1 << 62)

    def judge(self, at: int, seq: int, kind: str, token: int, ok: bool, lease: int, interval: int) -> str | None:
        """The attempt's outcome; None for one that was judged before."""
        if (at, seq) <= (self.at, self.seq):
            return None
        self.at, self.seq = at, seq
        if kind in ("ENABLE", "DISABLE"):  # either ends a lease, and makes the watch due
            self.enabled, self.token, self.lease_until, self.next_due = kind == "ENABLE", -1, 0, at
            return "SET"
        if kind == "CLAIM":
            if not self.enabled:
                return "DISABLED"
            if self.next_due > at:
                return "NOT_DUE"
            if self.lease_until > at:
                return "LEASED"
            self.token, self.lease_until = token, at + lease
            return "GRANTED"
        if self.token < 0 or token != self.token or self.lease_until <= at:
            return "WATCH_LEASE_LOST"
        self.token, self.lease_until, self.next_due = -1, 0, at + interval
        if not ok:
            return "FAILED"
        self.version += 1
        return "COMMITTED"


_STATE = "token long, lease_until long, next_due long, version long, enabled boolean, at long, seq long"


def outcomes(log: DataFrame, interval: int, lease: int = LEASE) -> DataFrame:
    """The log's rows (LOG) with their outcome, and the watch's version at a COMMITTED one. Rows that come again, and rows
    that come after a later one was judged, give nothing. Tokens are not negative."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watch = Watch(*state.get) if state.exists else Watch()
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        verdicts, versions = [], []
        for at, seq, kind, token, ok in zip(rows["at"], rows["seq"], rows["kind"], rows["token"], rows["ok"], strict=True):
            verdicts.append(watch.judge(int(at), int(seq), kind, -2 if pd.isna(token) else int(token), bool(ok), lease, interval))
            versions.append(watch.version if verdicts[-1] == "COMMITTED" else None)
        state.update(astuple(watch))
        rows = rows.assign(outcome=verdicts, version=pd.array(versions, dtype="Int64"))
        yield rows[rows["outcome"].notna()][[c.split()[0] for c in OUTCOME.split(", ")]]

    return log.groupBy("watch_id").applyInPandasWithState(run, OUTCOME, _STATE, "append", GroupStateTimeout.NoTimeout)


def publish(log: DataFrame, folder: str, interval: int, lease: int = LEASE) -> Published:
    """Runs the stream of a log over all there is, into the tables results (committed) and refused (the other attempts).

    The folder keeps the stream's progress: a second run goes on where the first one ended.
    """
    tables = Published(log.sparkSession, folder, {"results": OUTCOME, "refused": OUTCOME})
    taken: Column = F.col("outcome") == "COMMITTED"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            tables.write(epoch, results=batch.where(taken), refused=batch.where(~taken & ~F.col("outcome").isin("GRANTED", "SET")))
        finally:
            batch.unpersist()

    judged = outcomes(log, interval, lease)
    judged.writeStream.outputMode("append").option("checkpointLocation", f"{folder.rstrip('/')}/progress").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return tables


def versions(results: DataFrame) -> DataFrame:
    """The validity windows of the watched value, from committed results: (watch_id, value, valid_at, invalid_at, last_observed_at)."""
    return scd2(results, ["watch_id"], "at", "value")


def value_changes(results: DataFrame) -> DataFrame:
    """(watch_id, version, at, before, after, across_gap): a known value that differs from the last known one. Results
    without a value keep what was known; a change over such a gap is marked."""
    from pyspark.sql import Window

    w = Window.partitionBy("watch_id").orderBy("version")
    known = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = results.select("watch_id", "version", "at", known.alias("before"), F.col("value").alias("after"), F.lag("value").over(w).isNull().alias("across_gap"))
    return rows.where("before IS NOT NULL AND after IS NOT NULL AND before <> after")
