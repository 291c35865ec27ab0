"""Content terms, phrases and salient terms against plain Python and literals."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.functions import stopwords
from tidemark.functions import text as x
from tidemark.operators import phrases


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column("t")).first()[0]


def test_content_terms(spark):
    text = "Matcha latte from https://a.b/c via @ogre.bsky.social and news.example.co.jp/a, e.g. 3.5 抹茶ラテとスーパーカップ カ 今日"
    got = one(spark, x.content_terms, text)
    assert {"matcha", "latte", "via", "抹茶", "スーパーカップ", "今日", "ラテ"} <= set(got) and not {"ogre", "bsky", "example", "https", "カ", "と"} & set(got)
    assert one(spark, x.without_links, " www.a.b  x@y a.bc/d. example.com, e.g. ok") == "x@y e.g. ok"
    assert one(spark, x.content_terms, "") == [] and one(spark, x.content_terms, None) is None
    keep = ["matcha", "12", "a1b2c3", "600x400", "これ", "抹茶", "今日", "about", "latte"]
    df = spark.createDataFrame([(k,) for k in keep], "t string")
    assert [r.t for r in df.where(x.informative("t")).collect()] == ["matcha", "抹茶", "latte"]


def test_phrase_grams(spark):
    got = set(one(spark, lambda c: x.phrase_grams(c, 3), "Ceremonial grade matcha, whisk set and bamboo-whisk x don't melt 抹茶 ice cream"))
    assert got == {"ceremonial grade", "grade matcha", "ceremonial grade matcha", "whisk set", "don't melt", "ice cream"}
    assert one(spark, lambda c: x.phrase_grams(c, 3), "the and") == [] and one(spark, lambda c: x.phrase_grams(c, 3), "") == []


def brute(posts, longest):
    """The ranked pass over all phrases, longer ones of equal support first."""
    seen = defaultdict(lambda: defaultdict(lambda: [0, set()]))
    for group, author, text in posts:
        found = set()
        run = []
        for w in [*re.split(r"[^\w'-]", text.lower()), ""]:
            if len(w) < 2 or w in stopwords.BREAKS:
                for n in range(2, longest + 1):
                    found |= {" ".join(run[i : i + n]) for i in range(len(run) - n + 1)}
                run = []
            else:
                run.append(w)
        for p in found:
            seen[group][p][0] += 1
            seen[group][p][1].add(author)
    out = set()
    for group, ps in seen.items():
        kept = []
        for p, (n, authors) in sorted(((p, v) for p, v in ps.items() if v[0] >= 2 and len(v[1]) >= 2), key=lambda r: (-r[1][0], -len(r[0].split()), r[0])):
            if not any(n == m and f" {p} " in f" {q} " for q, m in kept):
                kept.append((p, n))
                out.add((group, p, n, len(authors), len(kept)))
    return out


def test_phrases_are_brute_force(spark):
    rng = random.Random(8)
    words = ["iced", "oat", "latte", "matcha", "the", "cup", "foam"]
    posts = [(rng.choice("ab"), rng.choice("xyz"), "".join(w + rng.choice([" ", " ", " ", ", "]) for w in rng.choices(words, k=rng.randrange(2, 12)))) for _ in range(300)]
    df = spark.createDataFrame(posts, "g string, who string, t string")
    shared = phrases.shared_phrases(df, "g", "who", "t", 4)
    want = brute(posts, 4)
    assert {(r.g, r.phrase, r.posts, r.authors) for r in shared.collect()} == {w[:4] for w in want}
    assert {(r.g, r.phrase, r.posts, r.k) for r in phrases.candidate_phrases(shared, "g").collect()} == {(g, p, n, k) for g, p, n, _, k in want if k <= 5}


def test_one_author_alone_and_bracketed_spans(spark):
    posts = [("g", "x", "green tea mochi"), ("g", "x", "green tea mochi"), ("g", "y", "「Green Tea Mochi」 sold"), ("g", "z", "so 「green  tea mochi」"), ("g", None, "red bean cake"), ("g", None, "red bean cake"), ("g", "w", None)]
    got = {r.phrase: (r.posts, r.authors, r.bracketed) for r in phrases.shared_phrases(spark.createDataFrame(posts, "g string, a string, t string"), "g", "a", "t").collect()}
    assert got == {"green tea mochi": (4, 3, True)}
    assert phrases.shared_phrases(spark.createDataFrame([], "g string, a string, t string"), "g", "a", "t").count() == 0
    terms = phrases.salient_terms(spark.createDataFrame(posts, "g string, a string, t string"), "g", "t", 2)
    assert [(r.term, r.posts, r.k) for r in terms.orderBy("k").collect()] == [("green", 4, 1), ("mochi", 4, 2)]
