import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries, resample

FOLDER = "/root/testdata/sf0.001"


def buckets(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]], len(w)


def expected(docs, target):
    s, t = Counter(b for _, x in docs for b in buckets(x)[0]), Counter(b for x in target for b in buckets(x)[0])
    big_s, big_t = float(sum(s.values()) + 10000), float(sum(t.values()) + 10000)
    rows, able = [], []
    for i, x in docs:
        found, words = buckets(x)
        total = sum(math.floor(1000 * math.log((float(t[b] + 1) * big_s) / (float(s[b] + 1) * big_t))) for b in found)
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None])
        if words >= 20:
            able.append(len(rows) - 1)
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for n, k in enumerate(able[: 25 * len(able) // 100]):
        rows[k][4] = n + 1
    return sorted(map(str, map(tuple, rows)))


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())))


def test_query_is_brute_force(spark):
    d = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    b = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()
    assert rows(queries.op11_resampling(spark, FOLDER)) == expected(list(zip(d["doc_id"], d["text"])), b["text"])


@pytest.mark.parametrize("small", [False, True])
def test_many_ranges_ties_and_odd_texts(spark, monkeypatch, small):
    """Also with ranges of eight rows, so that one score's rows are parted by id."""
    if small:
        monkeypatch.setattr(resample, "RANGE_ROWS", 8)
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "größe", "漢字", "x" * 80, "y" * 63, "z" * 64, "a1", "9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 5, 19, 20, 40, 300])))) for i in range(400)]
    docs += [(7, docs[7][1])] * 90 + [(None, docs[9][1] + " 1" * 20), (1000, None), (1001, ""), (1002, "...---\x00"), (1003, "w " * 50)]
    # ids of equal noise: none but the same id has it, so ties of a score come from repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = ["alpha größe 9 alpha", None, "q"]
    got = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    want = expected(docs, target)
    assert rows(got) == want
    ranks = sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_rows_of_one_score_are_parted_by_id(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 8)
    scored = [(i, 20 + i % 3, 3, 1, 5 if i % 10 else 9) for i in range(500)] + [(None, 30, 3, 1, 5)]
    random.Random(1).shuffle(scored)
    got = resample.rank(spark.createDataFrame(scored, "id long, n_words long, n_features long, weight long, score long").repartition(7), percent=60)
    order = sorted((r["rank"], r["id"]) for r in got.where("rank IS NOT NULL").collect())
    assert [i for _, i in order] == [i for _, i in sorted((-s, i) for i, _, _, _, s in scored if i is not None)][:300]
    assert got.count() == 501


def test_long_texts_come_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices(["one", "two", "Three", "vier" * 30], k=5000)).encode()
    whole = [b for b, _ in resample.Hasher().of([b"", text, b"a b"])]
    monkeypatch.setattr(resample, "PIECE", 100)
    monkeypatch.setattr(resample, "STEP", 70)
    monkeypatch.setattr(resample, "MEMORY", 3)
    cut = list(resample.Hasher().of([b"", text, b"a b"]))
    assert sorted(np.concatenate(whole).tolist()) == sorted(np.concatenate([b for b, _ in cut]).tolist())
    n = Counter()
    for _, sizes in cut:
        for i, k in sizes:
            n[i] += k
    assert dict(n) == {0: 0, 1: 9999, 2: 3} and len(cut) > 10


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_tournament_merges(k):
    rng = random.Random(k)
    lists = [sorted(rng.randrange(30) for _ in range(rng.randrange(6))) for _ in range(k)]
    tree, out = resample.Tournament(lists), []
    while (w := tree.next()) is not None:
        out.append((lists[w][tree.at[w] - 1], w))
    assert out == sorted((x, i) for i, one in enumerate(lists) for x in one)


def test_empty_tables_clashing_columns_and_the_drawn(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i)) for i in range(40)], "doc_id long, text string")
    target = docs.limit(3)
    for empty in (docs.limit(0), docs.where("doc_id < 3")):
        assert resample.resample(empty, target).where("rank IS NOT NULL").count() == 0
    assert resample.resample(docs, target.limit(0)).where("rank IS NOT NULL").count() == 7
    clash = docs.selectExpr("*", "1 AS id", "'r' AS rank", "2 AS score")
    ranked = resample.resample(clash, target)
    assert ranked.columns == ["doc_id", "n_features", "weight", "score", "rank"] and ranked.count() == 40
    got = resample.drawn(clash, ranked)
    assert got.columns == clash.columns and got.count() == 7 and got.where("rank = 'r'").count() == 7
