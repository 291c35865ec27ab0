import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, lm, near_dup, queries, toxicity
from tidemark.llm.common import store

FOLDER = "/root/testdata/sf0.001"


def grouped(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def five(text):
    """Shingles of five words, made without the code under test; a shorter text is one."""
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(rows, threshold=0.8):
    sets = {i: five(t) for i, t in rows}
    jac = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    ids = sorted(sets)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if jac(sets[a], sets[b]) >= threshold - 1e-12]


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def fixture():
    r = random.Random(3)
    make = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows, base = [], make(120)
    rows += [(i, edited(base, r, r.choice((0, 1, 1, 2, 3, 5)))) for i in range(60)]  # a crowded group
    for g in range(15):
        b = make(r.randrange(20, 200))
        rows += [(100 + 10 * g + k, edited(b, r, k % 3)) for k in range(4)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "ONE  two"), (405, "x " * 30000), (406, "x " * 29000)]
    return rows


def test_near_duplicates_are_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "sig", "node", "label", "class_id")})
    got = {r.doc_id: r for r in near_dup.classes(docs).collect()}
    links = similar(rows)
    want = grouped([i for i, _ in rows], links)
    assert {i: r.class_id for i, r in got.items()} == want
    degree = Counter(x for pair in links for x in pair)
    assert all(r.n_links == degree[i] for i, r in got.items())


def test_near_duplicates_count_all_links_of_a_crowded_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SQUARE", 50)  # more than one block
    rows = [(i, t) for i, t in fixture() if i >= 100]
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]  # so long that all pairs are far over the threshold
    texts = [edited(base, r, r.choice((0, 1, 1, 2))) for _ in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(texts + texts[:30])]  # copies count for each of their own
    got = {r.doc_id: r for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = similar(rows)
    degree = Counter(x for pair in links for x in pair)
    assert max(degree.values()) > 100
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (c, degree[i]) for i, c in grouped([i for i, _ in rows], links).items()}


def test_near_duplicates_of_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in queries.op7_near_duplicates(spark, FOLDER).collect()}
    want = grouped([i for i, _ in rows], similar(rows))
    assert got == want
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f")]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == [(-1, -1, 0), (3, 3, 1), (5, 3, 1), (5, 3, 1)]
    assert near_dup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_documents_with_several_texts(spark):
    r = random.Random(7)
    a, b = ([f"w{r.randrange(5000)}" for _ in range(60)] for _ in range(2))
    rows = [(7, " ".join(a)), (3, " ".join(a)), (7, " ".join(b)), (9, " ".join([*b, "more"])), (10, "something else that nobody says")]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == [(3, 3, 1), (7, 3, 1), (7, 3, 1), (9, 3, 1), (10, 10, 0)]


def test_components_of_chains(spark):
    r = random.Random(1)
    ids = r.sample(range(10**6), 200)
    edges = list(zip(ids[:100], ids[1:101], strict=True)) + list(zip(ids[120:150], ids[121:151], strict=True))
    got = {x.node: x.label for x in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped(set(ids[:101]) | set(ids[120:151]), edges)
    assert {frozenset(i for i in got if got[i] == l) for l in got.values()} == {frozenset(i for i in want if want[i] == l) for l in want.values()}


def test_recall_of_the_forest():
    k = near_dup.shortest_prefix(0.8)
    assert 1 - (1 - 0.8**k) ** near_dup.TREES >= near_dup.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** near_dup.TREES


def distance(pattern, text):
    """Least edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def mangled(s, r, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[i] = r.choice("xyzq")
        elif kind == 1:
            s.insert(i, r.choice("xyzq"))
        else:
            del s[i]
    return "".join(s)


def test_leaks_are_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randrange(10, 16)))) for i in range(12)] + [(50, "too short"), (51, None), (None, "x " * 60)]
    docs = [(0, None), (1, ""), (2, "nothing " * 50), (3, "that is Too\nSHORT"), (4, "too shorts"), (5, "too shrt"), (6, "y" + " x" * 60)]
    for i in range(60):
        n, t = r.choice(items[:12])
        noise = " ".join(word() for _ in range(r.randrange(0, 25)))
        docs.append((10 + i, f"{noise}\n{mangled(t, r, r.randrange(0, 12)).upper()}  {noise}"))
    got = {(x.doc_id, x.item_id): x.distance for x in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("distance", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for n, item in items[:12]:
            p = decontam.normal(item)
            e = distance(p, decontam.normal(t or ""))
            if len(p) >= 40 and e <= int(0.1 * len(p)):
                want[(d, n)] = e
    want |= {(3, 50): 0, (6, None): 0}
    assert len(want) > 20 and got == want


def test_leaks_of_tables(spark):
    docs, bench = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, FOLDER).collect()}
    texts = [(r.doc_id, decontam.normal(r.text)) for r in docs.collect()]
    assert {(d, b.item_id) for b in bench.collect() for d, t in texts if decontam.normal(b.text) in t} <= got
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in got}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_bit_parallel_distance():
    r = random.Random(4)
    for _ in range(300):
        p, t = ("".join(r.choice("ab") for _ in range(r.randrange(1, n))) for n in (90, 120))
        d = distance(p, t)
        assert decontam.myers(decontam.masks(p), len(p), t, d) == d
        assert d == 0 or decontam.myers(decontam.masks(p), len(p), t, d - 1) == d


def toxic_rows(r, n):
    foul = [f"zorg{x}" for x in "abcdefgh"] + ["idiot", "moron"]
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 8)))
    for i in range(n):
        bad = i % 5 == 0
        words = [word() for _ in range(r.randrange(20, 80))]
        for _ in range(6 * bad):
            words.insert(r.randrange(len(words)), r.choice(foul))
        yield i, " ".join(words), int(bad)


def test_toxicity_on_held_out_rows(spark):
    rows = list(toxic_rows(random.Random(8), 800))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string").withColumns({"score": F.lit("x"), "votes": F.lit(1)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("id") % 4 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 4 == 0]
    assert sum((s >= 0.5) == y for s, y in held) >= 0.97 * len(held)
    assert 0 <= got[9001] < 0.5 and got[9001] == got[9002]
    assert toxicity.score(docs.limit(0), model).count() == 0
    bare = toxicity.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert 0 <= bare.score("anything") <= 1


def test_label_model_learns_rates_and_ties(spark):
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    v = np.zeros((4000, toxicity.VOTERS), bool)
    v[:, 0] = np.where(y, r.random(4000) < 0.7, r.random(4000) < 0.02)
    v[:, 1] = v[:, 0]  # says nothing new
    v[:, 2] = np.where(y, r.random(4000) < 0.6, r.random(4000) < 0.03)
    v[:, 5] = np.where(y, r.random(4000) < 0.5, r.random(4000) < 0.02)
    rows = [(bytes(np.packbits(x)), float(t) if i < 400 else None) for i, (x, t) in enumerate(zip(v, y, strict=True))]
    m = toxicity.fit_labels(spark.createDataFrame(rows, "votes binary, y double"))
    assert abs(m.prior - 0.2) < 0.08 and abs(m.rates[1, 2] - 0.6) < 0.12 and m.rates[0, 2] < 0.08
    # Two that always agree are tied, so the second adds next to nothing; an independent one adds its own evidence.
    assert m.parent[1] == 0 or m.parent[0] == 1
    alone = lambda *on: m.posterior(np.isin(np.arange(toxicity.VOTERS), on)[None].astype(float))[0]
    odds = lambda p: np.log(p / (1 - p))
    assert abs(odds(alone(0, 1, 2)) - odds(alone(2)) - np.log(0.7 / 0.02 * 0.98 / 0.3)) < 1


def test_lm_base_and_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "The the THE unseenword"), (9003, "The the THE unseenword")], docs.schema)
    every = docs.union(odd).withColumns({"c": F.lit(1), "score": F.lit(2)})
    learn = F.crc32(F.col("doc").cast("string").cast("binary")) % 7 != 2
    got = lm.score(every, learn).collect()
    tokens = [(r.doc_id, (r.text or "").encode().lower().split() + [b" "]) for r in docs.union(odd).collect()]
    c = Counter(w for d, t in tokens if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((d, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for d, t in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and r.doc_id < 9000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = lm.score(every, learn).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)
    assert lm.score(every.limit(0), learn).count() == 0
    none = lm.score(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_tables_are_seated_customer_by_customer():
    d, n = 0.6, np.full(40_000, 6)
    rng = np.random.default_rng(1)
    t = lm.seat(n, np.full(40_000, 1.7), np.full(40_000, 0.2), d, rng)
    # Seat six customers every way: a new table weighs 1.7, and 0.2 more for each that there is.
    ways = {(1,): 1.0}
    for i in range(1, 6):
        more = defaultdict(float)
        for tables, p in ways.items():
            new = 1.7 + 0.2 * len(tables)
            every = new + i - d * len(tables)
            more[tuple(sorted((*tables, 1)))] += p * new / every
            for k in range(len(tables)):
                more[tuple(sorted((*tables[:k], tables[k] + 1, *tables[k + 1 :])))] += p * (tables[k] - d) / every
        ways = more
    assert sum(ways.values()) == pytest.approx(1)
    for k in range(1, 7):
        assert (t == k).mean() == pytest.approx(sum(p for x, p in ways.items() if len(x) == k), abs=0.01)
    assert lm.seat(np.array([0, 1]), np.ones(2), np.ones(2), d, rng).tolist() == [0, 1]
    assert lm.seat(np.zeros(0, int), np.ones(0), np.ones(0), d, rng).tolist() == []


def test_runs_of_customers_are_seated_as_single_ones(monkeypatch):
    args = np.full(4_000, 3_000), np.full(4_000, 5.0), np.full(4_000, 0.3), 0.7
    runs = lm.seat(*args, np.random.default_rng(2))
    monkeypatch.setattr(lm, "EXACT", 10_000)
    single = lm.seat(*args, np.random.default_rng(3))
    assert runs.mean() == pytest.approx(single.mean(), rel=0.02) and runs.std() == pytest.approx(single.std(), rel=0.08)


def test_predictions_of_every_context_sum_to_one(spark, monkeypatch):
    """Over all training words, the end of a text and one unknown word; several blocks; pairs that occur once and more often."""
    monkeypatch.setattr(lm, "BLOCK", 150)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(vocabulary[: 2 + i % 11]) for _ in range(r.randrange(1, 30))) for i in range(40)]
    words = sorted({w for t in texts for w in t.split()})
    probes = [f"{u} {w}" for u in [*words, "unseen"] for w in [*words, "unseen"]]
    docs = spark.createDataFrame(list(enumerate(texts + probes)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lm.score(docs, F.col("doc") < len(texts), each=True).collect()}
    assert all(x.score == pytest.approx(sum(x.token_scores)) and len(x.token_scores) == x.n_tokens for x in got.values())
    first, inner, end = {}, defaultdict(dict), {}
    for i, probe in enumerate(probes, len(texts)):
        u, w = probe.split()
        logs = [10**x for x in got[i].token_scores]
        first[u], inner[u][w], end[w] = logs
    for u, p in inner.items():
        assert sum(p.values()) + end[u] == pytest.approx(1, abs=1e-6)
    empty = spark.createDataFrame([(1, "x y")] + [(i, t) for i, t in enumerate(texts, 2)], "doc_id long, text string")
    assert lm.score(empty, F.col("doc") > 1).where("doc_id = 1").first().n_known == 1  # the end of text


def test_lm_scores_are_those_of_the_seating(spark):
    """Where no pair occurs twice, each has one table, and all but the parent's seating is known."""
    texts = ["a b c", "b a", "c c d"]
    docs = spark.createDataFrame([*enumerate(texts), (9, "a b d")], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.score(docs, F.col("doc") < 9, each=True).collect()}
    pairs = Counter()
    for t in texts:
        w = ["<", *t.split(), ">"]
        pairs.update(zip(w, w[1:], strict=False))
    assert set(pairs.values()) == {1}
    d, guests = 0.95, Counter(u for u, _ in pairs)  # all pairs once: the discount's upper bound
    scores = [10**x for x in got[9].token_scores]
    # b after a and a at the start were seen, d after b and the end after d: what is left is the parent's, below the rest of the room.
    for (u, w), p in zip([("<", "a"), ("a", "b"), ("b", "d"), ("d", ">")], scores, strict=True):
        seen = (pairs[u, w] - d * (pairs[u, w] > 0)) / (1 + guests[u])
        assert seen < p < seen + (1 + d * guests[u]) / (1 + guests[u])


def test_lm_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, "a"), (2, "a " * 300_000), (3, "\x1c\u00a0 \u00c9a \u00e9A"), (3, "\x1c\u00a0 \u00c9a \u00e9A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "train", "kind", "shard", "block", "data", "n_tokens")})
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in lm.score(docs, F.col("doc") == 2).collect())
    assert got == [("1", 1, 1), ("1", 2, 2), ("2", 300_001, 300_001), ("3", 4, 1), ("3", 4, 1), ("None", 3, 2)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    frames = [docs]
    for _, f in corpus_pipeline.STAGES:
        frames.append(store(f(spark, frames[-1], FOLDER), "stage"))
    assert all(f.columns == docs.columns and f.dtypes == docs.dtypes for f in frames[1:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] > ids[1] == ids[2] > ids[3] >= ids[4] == ids[5]
    rows = [(r.doc_id, r.text) for r in frames[2].collect()]
    assert ids[3] == set(grouped([i for i, _ in rows], similar(rows)).values())
    texts = {r.doc_id: decontam.normal(r.text) for r in frames[3].collect()}
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids[4] == {d for d, t in texts.items() if not any(i in t for i in items)}
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, run.collect())) == sorted(map(str, frames[-1].collect()))
