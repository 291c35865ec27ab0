"""Steps whose shuffles, rounds or rows had grown faster than their input, and sums that had depended on the order of tasks."""

import random
import re
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tests import oracle
from tests.test_clusters import POSTS, greedy, made
from tidemark.operators import clusters, leads
from tidemark.plans import text, trend

TEXTS = [(0, "alpha beta gamma"), (1, "alpha the"), (2, "beta"), (3, None), (4, ""), (5, "gamma alpha")]
ITEMS = [(1, "alpha"), (1, "alpha"), (1, "beta"), (2, "the and"), (2, "alpha beta"), (3, ""), (3, ""), (None, "gamma"), (5, None), (6, "alpha zeta")]


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_items_without_terms_and_equal_items(spark, tmp_path):
    written(spark, tmp_path, documents=(TEXTS, "doc_id long, text string"), benchmark=(ITEMS, "item_id long, text string"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    oracle.same(con, text.QUERIES["topic_subset"](spark, str(tmp_path)), text.ORACLE["topic_subset"])


def test_terms_of_a_document_are_moved_once(spark, tmp_path):
    """The join on a document's terms carries its row only; its whole list of terms joins after that."""
    written(spark, tmp_path, documents=(TEXTS, "doc_id long, text string"), benchmark=(ITEMS[:3], "item_id long, text string"))
    plan = text.QUERIES["topic_subset"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    each = re.findall(r"Generate explode\(t#\d+\), (\[|false)", plan)
    assert each and "false" not in each


def test_rounds_read_only_groups_near_in_time(spark, monkeypatch):
    """Each round is judged with the groups of the rounds whose posts are near in time, however many there were before."""
    paths, schema = [], spark.read.__class__.parquet
    monkeypatch.setattr(spark.read.__class__, "parquet", lambda self, *a, **k: paths.append([p for p in a if "judged" in p]) or schema(self, *a, **k))
    words = [f"w{i % 7}-{i % 3}-{k}" for i in range(20) for k in range(9)]
    posts = [("t", i, i * clusters.SPAN / 8, words[i % 40 : i % 40 + 9] + [f"x{i}"]) for i in range(400)] + [("few", i, 0.0, ["a", "b", "c"]) for i in range(3)]
    got = clusters.leader_clusters(spark.createDataFrame(posts, POSTS), 40)
    assert {tuple(r) for r in got.collect()} == greedy(posts)
    assert [len(p) for p in paths if p][:-1] and max(len(p) for p in [p for p in paths if p][:-1]) <= 2


def test_groups_with_more_terms_than_a_task_takes(spark, monkeypatch):
    """Groups of earlier rounds come whole, or with the terms that the round has too: the same."""
    monkeypatch.setattr(clusters, "TERMS", 900)
    posts = made(7, 400)
    got = clusters.leader_clusters(spark.createDataFrame(posts, POSTS), 50_000)
    assert {tuple(r) for r in got.collect()} == greedy(posts)


def test_values_are_added_in_the_order_of_rows(spark, tmp_path):
    """Whole sums of cents in several files, against the SQL on one thread; rows without a user or a type meet nothing."""
    rng, rows = random.Random(4), []
    for user in range(300):
        for day in (1, 20):
            cents = [rng.randrange(1, 50_000) for _ in range(7)]
            rows += [(datetime(2024, 1, day), user, c / 100) for c in [*cents, 100 * rng.randrange(1, 9) - sum(cents) % 100]]
    rng.shuffle(rows)
    rows = [(i, at + timedelta(seconds=i), user, "view", v) for i, (at, user, v) in enumerate(rows)]
    rows += [(9000 + i, datetime(2024, 1, d), u, k, 1.5) for i, (d, u, k) in enumerate([(1, None, "view"), (20, None, "view"), (1, 500, None), (20, 500, None), (1, 501, "view"), (20, 502, "view")])]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).repartitionByRange(5, "event_id").sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    oracle.same(con, trend.QUERIES["counter_delta"](spark, str(tmp_path)), trend.ORACLE["counter_delta"])


def test_pairs_of_one_kind_are_dealt_to_many_tasks(spark, monkeypatch):
    """Lists of candidates and suppliers are joined, not rows, so one kind isn't one task's; repeated rows are one."""
    monkeypatch.setattr(leads, "CANDIDATES", 8)
    monkeypatch.setattr(leads, "THINGS", 5)
    monkeypatch.setattr(leads, "PAIRS", 100)
    c = [(i, "abc", "o") for i in range(40)] + [(3, "abc", "o"), (None, "abc", "o"), (90, "x", None), (91, None, "p")]
    s = [(i, f"S{i}", "o") for i in range(30)] + [(5, "S5", "o"), (31, "-ABC-", "q"), (None, "n", "o"), (33, None, "p")]
    cs = spark.createDataFrame(c, "candidate long, brand string, origin string"), spark.createDataFrame(s, "supplier long, label string, origin string")
    got = leads.related(*cs)
    want = {(a, b, int("abc" in (label or "").lower() and brand == "abc")) for a, brand, o in c for b, label, p in s if (o and o == p) or (brand == "abc" and "abc" in (label or "").lower())}
    assert sorted(((r.candidate, r.supplier, int("LABEL" in r.association)) for r in got.collect()), key=str) == sorted(want, key=str)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < len(want) / 2
    t = spark.createDataFrame([(b, "s", f"u{b % 9}{e}") for b in range(30) for e in ("/contact", "")] + [(1, "s", "s")], "supplier long, source string, url string")
    by_row = leads.follow_ups(got, t).select("candidate", "url", "association", "points")
    by_kind = leads.related_follow_ups(*cs, t)
    assert by_kind.columns == by_row.columns and sorted(map(str, by_kind.collect())) == sorted(map(str, by_row.collect()))
