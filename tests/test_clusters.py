import random

import pytest

from tidemark.operators.clusters import SPAN, leader_clusters

POSTS = "topic string, post_id long, published double, terms array<string>"


def greedy(posts, shared=3, share=0.15, overlap=False):
    """One pass over each topic, with whole sets."""
    groups, out = {}, set()
    for topic, post, at, terms in sorted(posts, key=lambda p: (str(p[0]), p[1])):
        t = set(terms or ())
        for g in groups.setdefault(topic, []):
            both = len(t & g[1])
            of = min(len(t), len(g[1])) if overlap else len(t | g[1])
            if at is not None and g[2] is not None and abs(at - g[2]) <= SPAN and both >= shared and both >= share * of:
                g[1].update(t)
                out.add((topic, post, g[0]))
                break
        else:
            groups[topic].append((post, t, at))
            out.add((topic, post, post))
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        theme = rng.randrange(30)
        own = [f"t{theme}-{k}" for k in range(6)]
        terms = rng.sample(own, rng.randrange(2, 7)) + rng.sample(words[:20], rng.randrange(0, 4)) + rng.sample(words, rng.randrange(0, 12))
        rows.append((rng.choice("ab"), i, None if rng.random() < 0.02 else float(rng.randrange(40 * 86_400)), terms if rng.random() < 0.98 else []))
    return rows


@pytest.mark.parametrize("n, block, rule", [(2000, 400, {}), (500, 60, {"overlap": True, "share": 0.5}), (300, 5000, {"shared": 2})])
def test_clusters_are_those_of_one_pass(spark, n, block, rule):
    posts = made(n, n)
    got = leader_clusters(spark.createDataFrame(posts, POSTS).repartition(5), block, **rule)
    want = greedy(posts, **rule)
    assert {tuple(r) for r in got.collect()} == want and got.count() == n
    assert len({(t, g) for t, _, g in want}) < 0.9 * n


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], POSTS)
    assert leader_clusters(empty).count() == 0
    odd = [(None, 1, 0.0, ["a", "b", "c"]), (None, 2, 0.0, ["a", "b", "c"]), ("t", 1, None, ["a", "b", "c"]), ("t", 2, None, None)]
    assert {tuple(r) for r in leader_clusters(spark.createDataFrame(odd, POSTS)).collect()} == {(None, 1, 1), (None, 2, 1), ("t", 1, 1), ("t", 2, 2)}
