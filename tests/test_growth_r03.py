"""Steps that had grown faster than their input, or had been done several times over."""

from tidemark.functions import displayed
from tidemark.operators import leads, phrases
from tidemark.operators.clusters import SPAN, leader_clusters
from tidemark.operators.names import resolve


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_counted_once(spark):
    df = spark.createDataFrame([("g", "x", "green tea mochi"), ("g", "y", "green tea mochi")], "g string, a string, t string")
    shared = phrases.shared_phrases(df, "g", "a", "t")
    assert [(r.phrase, r.posts) for r in shared.collect()] == [("green tea mochi", 2)]
    assert "regexp_extract_all" not in plan(shared)


def test_repeated_names_are_compared_once(spark):
    names = spark.createDataFrame([(i, "ceremonial matcha latte powder tin large") for i in range(3000)], "id long, name string")
    known = spark.createDataFrame([(i, "ceremonial matcha latte powder tin larger") for i in range(9000, 6000, -1)], "id long, name string")
    got = resolve(names, known).groupBy("match", "state").count().collect()
    assert [tuple(r) for r in got] == [(6001, "SIMILAR", 3000)]


def test_groups_far_in_time_are_not_met(spark):
    terms = [f"t{i}" for i in range(20)]
    posts = [("a", i, (i - 3000) * (SPAN + 1.0), terms) for i in range(6000)] + [("b", 1, -1.0, terms), ("b", 2, SPAN - 1.0, terms), ("b", 3, SPAN * 1.0, terms)]
    got = leader_clusters(spark.createDataFrame(posts, "topic string, post_id long, published double, terms array<string>"), 6000)
    assert sorted(tuple(r) for r in got.where("topic = 'b'").collect()) == [("b", 1, 1), ("b", 2, 1), ("b", 3, 3)]
    assert got.where("topic = 'a' AND post_id = leader").count() == 6000


def test_related_pairs_are_not_aggregated(spark):
    c = spark.createDataFrame([(1, "Abc", "o"), (1, "zzz", "p"), (2, "abc", "o"), (3, None, "p"), (4, None, None)], "candidate long, brand string, origin string")
    s = spark.createDataFrame([(10, "xabcx", "o"), (11, "no", "p"), (11, "no", "p"), (12, None, "o")], "supplier long, label string, origin string")
    r = leads.related(c, s)
    assert sorted((x.candidate, x.supplier, "LABEL" in x.association) for x in r.collect()) == [(1, 10, True), (1, 11, False), (1, 12, False), (2, 10, True), (2, 12, False), (3, 11, False)]
    assert "min(how" not in plan(r).split("Join")[0]
    t = spark.createDataFrame([(10, "s", "u"), (12, "s", "u"), (11, "s", "s")], "supplier long, source string, url string")
    assert sorted((x.candidate, x.url) for x in leads.related_follow_ups(c, s, t).collect()) == [(1, "u"), (2, "u")]


def test_a_count_is_matched_once(spark):
    df = spark.createDataFrame([("1.2万",)], "t string").select(displayed.count_bounds("t").alias("b"))
    assert tuple(df.first().b) == (12000, 11500, 12999)
    assert plan(df).count("regexp_extract") <= 6
