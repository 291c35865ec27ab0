from datetime import datetime, timedelta

from tidemark.streaming import events as s


def test_updates_over_several_batches(spark, tmp_path):
    """Events in four files, the last of them late for the first windows: rows within the watermark update their window, and
    what is later is left out."""
    t0 = datetime(2024, 1, 1)
    parts = [[(1, 0), (2, 10), (3, 59)], [(4, 61), (5, 30), (6, 600)], [(8, 601), (9, 550)], [(7, 20)]]
    for k, part in enumerate(parts):
        rows = [(i, t0 + timedelta(minutes=m), 1, "a", 1.0, "{}") for i, m in part]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/x{k}")
        (file,) = (tmp_path / f"x{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"events{k}.parquet")
    got = s.drain(s.tumbling(s.read_events(spark, f"{tmp_path}/in", per_trigger=1), "1 hour"), "update", ["start", "event_type"]).collect()
    base = 1704067200
    # Minute 20 comes after minute 600 has moved the watermark to 540: too late. Minute 550 is within it.
    assert {(r.start - base) // 3600: r.n for r in got} == {0: 4, 1: 1, 9: 1, 10: 2}
