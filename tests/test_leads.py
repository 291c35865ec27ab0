import hashlib
import hmac
import random

from pyspark.sql import functions as F

from tidemark.functions.keyed import hmac_sha256, pseudonym
from tidemark.operators import leads, snapshots
from tidemark.sources import bundles


def test_containment_is_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abAB ", k=n))
    names = [word(rng.randrange(0, 6)) for _ in range(120)] + [None, "größe", "abab"]
    labels = [word(rng.randrange(0, 14)) for _ in range(150)] + [None, "die größen", "x"]
    got = leads.contained_in(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(x,) for x in labels], "l string"), "n", "l")
    want = {(n, x) for n in names for x in labels if n is not None and x is not None and len(n) >= 3 and n in x}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 50


def test_related_prefers_the_brand_and_drops_unknowns(spark):
    c = spark.createDataFrame([(1, "ACME", "a"), (2, "ac", "b"), (3, None, None), (4, "acme", None)], "candidate long, brand string, origin string")
    s = spark.createDataFrame([(10, "The Acme Co", "a"), (11, "other", "b"), (12, None, None)], "supplier long, label string, origin string")
    got = {(r.candidate, r.supplier): r.association.split("_")[1] for r in leads.related(c, s).collect()}
    assert got == {(1, 10): "BRAND", (2, 11): "SHARED", (4, 10): "BRAND"}
    t = spark.createDataFrame([(10, "h/", "h/"), (10, "h/", "h/contact"), (10, "h/", "h/contact"), (10, "h/", "h/about")], "supplier long, source string, url string")
    assert {(r.candidate, r.url, r.points) for r in leads.follow_ups(leads.related(c, s), t).collect()} == {(i, u, p) for i in (1, 4) for u, p in (("h/contact", 100), ("h/about", 50))}


def test_leads_come_and_go(spark):
    schema = "topic string, lead string, post long, author string, text string"
    old = [("t", "a", 1, "x", "p"), ("t", "a", 2, "y", "q"), ("t", "b", 3, "x", "p"), ("t", "b", 4, "y", "q"), ("t", "c", 9, "x", "p"), ("t", "c", 10, "y", "q")]
    new = [("t", "a", 1, "x", "p"), ("t", "a", 2, "y", "q"), ("t", "b", 3, "x", "p"), ("t", "b", 7, "z", "q"), ("t", "d", 1, "x", "p"), ("t", "d", 8, "y", "q"), ("u", "a", 1, "x", "p"), ("u", "a", 2, "y", "q")]
    new += [("t", "same", 20, "x", "p"), ("t", "same", 21, "x", "q"), ("t", "copied", 22, "x", "p"), ("t", "copied", 23, "y", "p"), ("t", "alone", 24, "x", "p")]
    now, before = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    got = {(r.topic, r.lead): (r.posts, r.fresh, r.state.split("_")[0] + ("_ONLY" if "ONLY" in r.state else "")) for r in leads.recurrence(now, before).collect()}
    assert got == {("t", "a"): (2, 0, "RECURRING_ONLY"), ("t", "b"): (2, 1, "RECURRING"), ("t", "c"): (0, 0, "GONE"), ("t", "d"): (2, 1, "NEW"), ("u", "a"): (2, 2, "NO")}
    states = {r.lead: r.state for r in leads.hypotheses(now).where("topic = 't'").collect()}
    assert states["same"] == "ONE_ACCOUNT_REPEATING" and states["copied"] == "ONE_TEXT_COPIED_ACROSS_ACCOUNTS" and "alone" not in states


def test_hmac_and_pseudonyms(spark):
    key = bytes(range(7, 39))
    df = spark.createDataFrame([("p", "Größe"), ("p", ""), ("p", "anon1:0123456789abcdef"), ("p", None), (None, "h"), ("q", "größe")], "p string, h string")
    got = [r.a for r in df.select(pseudonym(key, "p", "h").alias("a")).collect()]
    mac = lambda m: "anon1:" + hmac.new(key, m.encode(), hashlib.sha256).hexdigest()[:16]
    assert got == [mac("p|größe"), mac("p|"), "anon1:0123456789abcdef", None, None, mac("q|größe")]
    for k in (b"", b"k" * 64, b"long" * 40):
        assert df.select(hmac_sha256(k, F.lit("m"))).first()[0] == hmac.new(k, b"m", hashlib.sha256).hexdigest()


def test_exports_prove_themselves(spark):
    """A change, a removal, an addition and a swap of records, another watch, another root and a broken link within."""
    n = 23
    records = [(e, i, f"record {e} {i}") for e in range(9) for i in range(n if e < 8 else 0)]
    watches = spark.createDataFrame([(e, f"watch {e}") for e in range(9)], "export long, watch string")
    frame = lambda rows: spark.createDataFrame(rows, "export long, index long, payload string")
    entries, links = bundles.manifest(watches, frame(records), stretch=5)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    link = sha(f"{bundles.FORMAT}:{sha('watch 0')}")
    for i in range(n):
        link = sha(f"{link}:{sha(f'record 0 {i}')}")
    assert links.where("export = 0").orderBy(F.desc("stretch")).first().link == link
    found = [(e, i, p + "!" if (e, i) == (1, 13) else p) for e, i, p in records if (e, i) != (2, 22)] + [(3, 23, "more")]
    found = [(e, {4: 6, 6: 4}.get(i, i) if e == 4 else i, p) for e, i, p in found]
    stated = watches.select("export", F.sha2("watch", 256).alias("watch_sha256"))
    other = watches.withColumn("watch", F.when(F.col("export") == 5, "another").otherwise(F.col("watch")))
    wrong = links.withColumn("link", F.when(F.expr("export = 6 AND stretch = 5 OR export = 7 AND stretch = 2"), "0").otherwise(F.col("link")))
    got = {r.export: (r.state.split("_")[1] if "_" in r.state else r.state, r.first_break) for r in bundles.verify(other, frame(found), stated, entries, wrong, stretch=5).collect()}
    assert got == {0: ("VERIFIED", None), 1: ("RECORD", 13), 2: ("RECORD", 22), 3: ("RECORD", 23), 4: ("RECORD", 4), 5: ("WATCH", None), 6: ("ROOT", 20), 7: ("ROOT", 5), 8: ("VERIFIED", None)}


def test_capped_counts_give_intervals(spark):
    """Counts 4, 9 (capped at 9), 9 (capped), 3: only the differences that a capped count bounds have that bound."""
    rows = [("t", 3600 * (i + 1), n, 2, 2, f, n >= 9) for i, (n, f) in enumerate([(4, 4), (9, 7), (9, 1), (3, 0), (5, 2)])]
    df = spark.createDataFrame(rows, "topic string, at long, n long, sources long, platforms long, fresh long, capped boolean")
    got = snapshots.scored(df, ["topic"]).orderBy("at").collect()
    assert [(r.velocity_low, r.velocity_high) for r in got] == [(None, None), (5.0, None), (None, None), (None, -6.0), (2.0, 2.0)]
    assert [r.left_out for r in got] == [[], ["velocity", "acceleration"], ["velocity", "acceleration"], ["velocity", "acceleration"], []]
    assert [round(r.coverage, 6) for r in got] == [0.3, 0.75, 0.75, 0.75, 0.85]
    assert abs(got[1].score - (0.15 + 0.2 * 2 / 3 + 0.1 * 7 / 9 + 0.1 + 0.2 * 7 / 8)) < 1e-9
