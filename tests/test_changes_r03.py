from datetime import datetime, timedelta

from tidemark.streaming import events as s


def test_changes_over_epochs(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, 0, 1, 5.0), (2, 1, 1, 25.0), (3, 2, 1, None), (4, 3, 1, 26.0), (5, 4, 1, 1.0), (6, 5, 2, 3.0), (7, 6, 1, float("nan")), (8, 7, 1, 50.0), (9, 8, 2, -1.0)]
    for k in range(3):
        part = [(i, at + timedelta(hours=h), u, "view", v, "{}") for i, h, u, v in rows[3 * k : 3 * k + 3]]
        spark.createDataFrame(part, s.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        for n, p in enumerate((tmp_path / f"made{k}").glob("*.parquet")):
            p.rename(tmp_path / f"events{k}{n}.parquet")
    want = {(1, 2, 0, 1), (1, 5, 1, 0), (1, 8, 0, 2), (2, 9, 0, -1)}
    for per_trigger in (None, 1):
        got = s.drain_changes(s.changes(s.read_events(spark, str(tmp_path), per_trigger), 20.0))
        assert {(r.user_id, r.event_id, r.before, r.after) for r in got.collect()} == want
