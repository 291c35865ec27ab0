import random

import pytest

from tidemark.operators import frontier
from tidemark.streaming import watches
from tidemark.streaming.publish import Published

COLUMNS = "watch_id long, seq long, at long, kind string, token long, ok boolean, value double"


def attempts(seed, n=1200):
    """Workers that claim, finish in time, late or twice, and others that finish under tokens they don't hold."""
    rng, rows, at, token, held = random.Random(seed), [], 0, 0, {}
    for seq in range(n):
        at += rng.choice([0, 10, 20, 60])
        watch = rng.randrange(4)
        if rng.random() < 0.5:
            token += 1
            held.setdefault(watch, []).append(token)
            rows.append((watch, seq, at, "CLAIM", token, True, None))
        elif rng.random() < 0.05:
            rows.append((watch, seq, at, rng.choice(["ENABLE", "ENABLE", "DISABLE"]), None, True, None))
        else:
            rows.append((watch, seq, at, "FINISH", rng.choice(held.get(watch, [0])[-3:]), rng.random() < 0.8, float(rng.randrange(3)) if rng.random() < 0.8 else None))
    return rows


def brute(rows, interval, lease=180):
    """The rules, one attempt after another."""
    held, out = {}, []
    for w, seq, at, kind, token, ok, value in sorted(rows, key=lambda r: (r[2], r[1])):
        s = held.setdefault(w, {"token": None, "until": 0, "due": 0, "on": True})
        if kind in ("ENABLE", "DISABLE"):
            s.update(on=kind == "ENABLE", token=None, until=0, due=at)
        elif kind == "CLAIM":
            if s["on"] and s["due"] <= at and s["until"] <= at:
                s.update(token=token, until=at + lease)
        elif s["token"] == token and s["until"] > at:
            s.update(token=None, until=0, due=at + interval)
            if ok:
                out.append((w, seq, at, value))
    return sorted(out, key=str)


def stream(spark, folder):
    return spark.readStream.schema(COLUMNS).parquet(folder)


def rows_of(tables):
    return sorted(((r.watch_id, r.seq, r.at, r.value) for r in tables.read("results").collect()), key=str)


def test_replays_and_stale_workers_change_nothing(spark, tmp_path):
    rows = attempts(1)
    want = brute(rows, 100)
    assert len(want) > 12
    one = f"{tmp_path}/one"
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{one}/log")
    clean = watches.publish(stream(spark, f"{one}/log"), f"{one}/tables", 100)
    assert rows_of(clean) == want

    many = f"{tmp_path}/many"
    for k in range(0, len(rows), 300):  # a part comes again with the next one
        spark.createDataFrame(rows[max(0, k - 50) : k + 300], COLUMNS).write.mode("append").parquet(f"{many}/log")
        tables = watches.publish(stream(spark, f"{many}/log"), f"{many}/tables", 100)
    assert rows_of(tables) == want
    assert sorted(map(str, watches.versions(tables.read("results")).collect())) == sorted(map(str, watches.versions(clean.read("results")).collect()))
    last = {}
    for r in tables.read("results").orderBy("at", "seq").collect():
        last[r.watch_id] = last.get(r.watch_id, 0) + 1
        assert r.version == last[r.watch_id]


def test_a_batch_that_failed_half_way_is_written_again(spark, tmp_path):
    """The first table was written, the second failed: nothing shows; the batch runs again and shows once."""
    tables = Published(spark, f"{tmp_path}/t", {"a": "x long", "b": "x long"})
    good, more = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    with pytest.raises(Exception):
        tables.write(0, a=good, b=good.selectExpr("raise_error('lost') AS x"))
    assert tables.committed() == [] and tables.read("a").count() == 0
    assert tables.write(0, a=good, b=more) and not tables.write(0, a=more, b=more)
    assert tables.write(1, a=good, b=good)
    assert (tables.read("a").count(), tables.read("b").count(), tables.committed()) == (6, 8, [0, 1])


def test_value_changes_mark_gaps(spark):
    r = spark.createDataFrame([(1, i, 10 * i, "FINISH", i, True, v, "COMMITTED", i) for i, v in enumerate([None, 5.0, 5.0, None, 7.0, 8.0, None])], watches.OUTCOME)
    got = [(x.version, x.before, x.after, x.across_gap) for x in watches.value_changes(r).orderBy("version").collect()]
    assert got == [(4, 5.0, 7.0, True), (5, 7.0, 8.0, False)]
    assert watches.value_changes(r.limit(0)).count() == 0


def test_reports_are_fenced(spark):
    urls = spark.createDataFrame(
        [("r", i, f"o{i % 2}", "LEASED" if i else "PENDING", 10 + i if i else None, 100 if i else None, 0, None, 3) for i in range(6)] + [("c", 9, "o", "LEASED", 1, 100, 0, None, 3)],
        "run_id string, identity long, origin string, state string, lease_token long, lease_until long, next_at long, last_error string, priority int",
    )
    reports = [
        ("r", 1, 11, 50, "HANDLED", 50, None, None, None),
        ("r", 1, 11, 60, "RETRYABLE", 90, "again", None, 999),  # the lease ended with the first report
        ("r", 2, 11, 50, "HANDLED", 50, None, None, 999),  # another's token
        ("r", 3, 13, 100, "HANDLED", 50, None, None, 999),  # too late
        ("r", 4, 14, 99, "RETRYABLE", 120, "HTTP_STATUS_503", 7, 150),
        ("r", 0, None, 50, "HANDLED", 50, None, None, None),
        ("r", 77, 1, 50, "HANDLED", 50, None, None, None),
        ("c", 9, 1, 50, "HANDLED", 50, None, None, 999),
    ]
    reports = spark.createDataFrame(reports, "run_id string, identity long, token long, at long, state string, next_at long, reason string, priority int, origin_not_before long")
    origins = spark.createDataFrame([("r", "o0", 140), ("r", "o1", 160)], "run_id string, origin string, next_at long")
    after, later, verdicts = frontier.transition(urls, origins, reports, spark.createDataFrame([("c",)], "run_id string"))
    got = {(r.run_id, r.identity): (r.state, r.lease_token, r.next_at, r.last_error, r.priority) for r in after.collect()}
    assert got[("r", 1)] == ("HANDLED", None, 50, None, 3) and got[("r", 4)] == ("RETRYABLE", None, 120, "HTTP_STATUS_503", 7)
    assert got[("r", 2)] == ("LEASED", 12, 0, None, 3) and got[("r", 3)][0] == got[("c", 9)][0] == "LEASED" and got[("r", 0)][0] == "PENDING"
    assert after.columns == urls.columns and after.count() == 7
    assert {(r.origin, r.next_at) for r in later.collect()} == {("o0", 150), ("o1", 160)}
    assert sorted(r.outcome for r in verdicts.collect()) == ["HANDLED", "RETRYABLE"] + ["STALE_OR_CANCELLED_LEASE"] * 6
    stopped = {r.identity: (r.state, r.lease_token) for r in frontier.cancel(after, spark.createDataFrame([("r",)], "run_id string")).collect()}
    assert stopped[1] == ("HANDLED", None) and stopped[2] == stopped[4] == stopped[0] == ("CANCELLED", None) and stopped[9] == ("LEASED", 1)
