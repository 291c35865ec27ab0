import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidemark.llm import exact_dedup, queries

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"{sha256(str(i).encode()).hexdigest()[: 3 + i % 7]} größe 漢字" for i in range(9000))
DOCS = [
    (5, "a  b"), (3, "a b"), (9, "a\t\n b"), (4, "a b "), (7, None), (6, ""), (8, " "), (8, "\n\n"), (2, "A b"),
    (11, LONG), (10, LONG.replace(" ", "\n\r", 5)), (12, LONG + "!"), (13, "!" + LONG), (3, "a b"), (None, "a b"), (None, "only without an id"),
    (14, "x" * 50000), (15, "x" * 50000), (16, "x" * 49999), (17, "a\x00b"), (18, "a b"), (19, "😀" * 9000), (20, "😀" * 9000),
]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(norm(t), []).append(d)
    rows = []
    for d, t in docs:
        g = groups[norm(t)]
        rows.append((str(d), min((x for x in g if x is not None), default=None), len(g), sha256(norm(t).encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("cut", [{}, {"bits": 3, "least": 16, "most": 64}, {"bits": 1, "least": 5, "most": 7}])
def test_classes_are_brute_force(docs, cut):
    """Also with hashes of one to three bits, where nearly all chunks share one."""
    got = exact_dedup.classes(docs.where("doc_id IS NULL OR doc_id < 14 OR doc_id > 16") if cut else docs, **cut)
    want = expected([(d, t) for d, t in DOCS if not cut or d is None or d < 14 or d > 16])
    rows = got.collect()
    assert sorted([(str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("cut", [{}, {"bits": 2, "least": 16, "most": 64}])
def test_texts_come_back_from_their_recipes(docs, cut):
    some = docs.where("doc_id IN (3, 5, 6, 10, 11, 19)")
    recipe = exact_dedup.recipes(some, **cut)
    back = exact_dedup.rebuild(recipe, exact_dedup.chunk_store(some, "text", **cut))
    got = recipe.join(back, "row").select(F.sha2(back["text"], 256), "text_sha256").collect()
    assert len(got) == some.count() and all(a == b for a, b in got)


def test_chunks_follow_the_content(spark):
    """A byte before a long text changes its first chunk only."""
    a, b = (spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"), 64, 1024).alias("c")).first().c for t in (LONG, "!" + LONG))
    assert "".join(a).encode("latin-1").decode() == LONG
    assert len(a) > 200 and len(set(a) & set(b)) > 0.9 * len(set(a))
    assert max(map(len, a)) <= 1024 and min(map(len, a[:-1])) >= 64


def test_clashing_columns_and_empty_tables(spark, docs):
    clash = docs.withColumns({c: F.lit(c) for c in ("row", "key", "hashes", "alts", "size", "first_id", "keep_id", "k", "a", "norm__", "chunks__")})
    got = exact_dedup.classes(clash)
    assert got.columns == ["doc_id", "text", "row", "key", "hashes", "alts", "size", "first_id", "k", "a", "norm__", "chunks__", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.where("row = 'row' AND hashes = 'hashes'").count() == len(DOCS)
    assert exact_dedup.classes(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(clash)
    assert kept.columns == clash.columns and kept.count() == len({norm(t) for _, t in DOCS})


def test_query(spark):
    got = queries.op13_exact_dedup(spark, FOLDER)
    same(connect(FOLDER), got, queries.OP13)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
