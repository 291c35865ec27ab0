import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidemark.llm import line_dedup, mixing, quality, queries

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
DOCS = [
    (1, "A repeated line here\nfirst"),
    (2, "a REPEATED line here \nÉtude en noir et bleu\nsecond"),
    (2, "a REPEATED line here \nÉtude en noir et bleu\nsecond"),
    (2, "other text of the same id\nA repeated line here"),
    (3, None),
    (4, ""),
    (5, "\n\nshort\nA repeated line here\nA repeated line here\nétude en noir et bleu\n"),
    (6, "short\nÉtude en noir et bleu"),
    (None, "A repeated line here"),
    (7, "A repeated line here"),
]


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def expected_lines(docs):
    where = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                where[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(where[key(x)]) < 2 or min(where[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def test_line_dedup_is_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))
    assert sorted(map(str, map(tuple, got.collect()))) == expected_lines(DOCS)


def test_line_dedup_keeps_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("doc", "tag", "pos", "h1", "gone", "n", "first", "n_lines")})
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "doc", "tag", "pos", "h1", "gone", "n", "first", "n_lines", "n_dropped"]
    assert got.where("doc = 'doc' AND gone = 'gone'").count() == len(DOCS)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_with_more_documents_asked_for(spark):
    docs = spark.createDataFrame([(i, "a line that all have\n" + ("two have this one" if i < 2 else str(i))) for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_repeated_lines(docs, min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_op5_oracle(spark):
    same(connect(FOLDER), queries.op5_line_dedup(spark, FOLDER), queries.ORACLE_SQL["op5_line_dedup"])


def water(sizes):
    """Targets by resharing, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("case", ["tables", "odd"])
def test_mixing(spark, case):
    if case == "tables":
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    else:
        rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (3, "", None), (4, "w " * 9000, None), (None, "q r", "z"), (5, "s t u", "z"), (6, "one", "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("h", "size", "sid", "rank", "id")})
    rows = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in docs.collect()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    want = water(sizes)
    runs = [sorted(map(str, map(tuple, mixing.taken(*mixing.mix(docs)).select("doc", "size", "source_size", "target", "taken").collect()))) for _ in range(2)]
    assert runs[0] == runs[1]
    got = mixing.taken(*mixing.mix(docs)).collect()
    assert sorted((str(r.doc), r["size"]) for r in got) == sorted((str(d), n) for d, n, _ in rows)
    assert Counter((r.source_size, round(r.target, 3)) for r in got) == Counter((sizes[s], round(want[s], 3)) for _, _, s in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[(r.sid, round(r.target))] += r.taken
    assert all(abs(n - t) <= 1 for (_, t), n in by.items())


def test_mixing_pieces_are_disjoint_runs_of_slots(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sized, pieces = mixing.mix(docs, block=512)
    p = pieces.join(sized.select("row_id", "sid", "size"), "row_id").collect()
    slots = defaultdict(int)
    owner = defaultdict(set)
    runs = defaultdict(list)
    for r in p:
        slots[r.slot] += r.words
        owner[r.slot].add(r.sid)
        runs[(r.row_id, r.epoch)].append((r.start, r.words))
        assert r.start >= 0 and r.words > 0 and r.start + r.words <= r["size"]
    assert max(slots.values()) <= 512 and all(len(s) == 1 for s in owner.values())
    for x in runs.values():
        x.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(x, x[1:], strict=False))


def test_mixed_texts_are_the_words_of_the_pieces(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (4, " ".join(f"w{i}" for i in range(3000)), None), (None, "q\n r", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized, pieces = mixing.mix(docs, block=512)
    texts = {i: (t or "").split() for i, t, _ in rows}
    got = mixing.text_of(docs, pieces).join(pieces.select("slot", "row_id", "epoch", "start", "words", "doc"), ["slot", "row_id", "epoch", "start"]).collect()
    assert len(got) == pieces.count() > 6
    assert all(r.text.split(" ") == texts[r.doc][r.start : r.start + r.words] for r in got)


def test_mixing_empty(spark):
    sized, pieces = mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert sized.count() == 0 and pieces.count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts_are_brute_force(spark):
    texts = [None, "", " \n ", "a b c d e a b c d e", "x\ny\nx\n\n\nx ", "é|#\x0b\x1c ü<>", "z " * 40, "a b c d e f a b c d e g b c d e f"]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_words": F.lit("mine"), "t__": F.lit(1)})
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measure(docs.drop("t__")).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs.withColumns({"mu": F.lit(1), "kept": F.lit("x"), "level": F.lit(2)})).select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(docs, "doc_id").collect()
    good = [r for r in labels if r.quality == 1 and len(r.text.split()) >= 10]
    bad = [r for r in labels if r.quality == 0]
    assert sum(r.doc_id not in kept for r in good) <= 0.01 * len(good)
    assert sum(r.doc_id in kept for r in bad) <= 0.15 * len(bad)
    same_columns = quality.keep_good(docs.limit(0))
    assert same_columns.columns == docs.columns and same_columns.count() == 0
    few = spark.createDataFrame([(1, None, None, "one two three four five six seven eight nine ten"), (2, "en", "s", None)], "doc_id long, lang string, source string, text string")
    assert [r.doc_id for r in quality.keep_good(few).collect()] == [1]


def regular(cov, var):
    """As the operator says it: the least share of the unit matrix with which the condition number is at most 100."""
    sd = np.sqrt(var)
    k = cov / np.outer(sd, sd)
    for share in (0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5):
        m = (1 - share) * k + share * np.eye(len(sd))
        w = np.linalg.eigvalsh(m)
        if w[0] > 0 and w[-1] <= 100 * w[0]:
            break
    return m * np.outer(sd, sd)


def least_determinant(x, share=0.65):
    """The estimate of least determinant by plain NumPy on one group, from the shortest halves, and from fifty random starts."""
    h, s = math.ceil(share * len(x)), np.sort(x, 0)
    half = len(x) // 2
    width = s[half:] - s[: len(x) - half]
    at = width.argmin(0)
    mid, var = s[at + half // 2, range(5)], (width[at, range(5)] / 1.349) ** 2
    var = np.where(var > 0, var, x.var(0))
    rng, best = np.random.default_rng(0), []
    starts = [(mid, np.diag(var))] + [(x[i].mean(0), np.cov(x[i].T, bias=True)) for i in (rng.choice(len(x), 20, replace=False) for _ in range(50))]
    for mu, c in starts:
        m, old = regular(c, var), np.inf
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(m), x - mu)
            near = x[np.argpartition(d, h - 1)[:h]]
            mu, m = near.mean(0), regular(np.cov(near.T, bias=True), var)
            det = np.linalg.slogdet(m)[1]
            if old - det < 1e-6:
                break
            old = det
        best.append((det, mu, m))
    return min(best, key=lambda b: b[0])


def test_quality_fits_have_the_least_determinant(spark):
    """At all three levels, against a version that shares no code with the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = quality.measure(docs, keep_text=False).cache()
    fits = {(r.level, r.lang_, r.source_): r for r in quality.fit(measured).collect()}
    rows = measured.where(~quality.base_failed()).select("lang", "source", *[c.alias(n) for n, c in quality.vector().items()]).collect()
    lang = max({r.lang for r in rows}, key=lambda v: sum(r.lang == v for r in rows))
    own = [k for k in fits if k[0] == 0][:1]
    for key in [(2, None, None), (1, lang, None), *own]:
        x = np.array([r[2:] for r in rows if key[0] == 2 or (r.lang == key[1] and (key[0] == 1 or r.source == key[2]))])
        fitted, (det, mu, m) = fits[key], least_determinant(x)
        got = np.linalg.inv(np.array(fitted.inv).reshape(5, 5))
        scale = np.linalg.slogdet(got)[1] - det  # of the factor that makes it consistent, and of the start
        assert fitted.n == len(x) and fitted.still
        assert np.abs((np.array(fitted.mu) - mu) / np.sqrt(np.diag(m))).max() < 0.35
        assert 5 * math.log(1.2) < scale < 5 * math.log(2.2)


@pytest.mark.parametrize("share", [0.12, 0.3])
def test_quality_rejects_junk_up_to_a_third(spark, share):
    """Groups of 700 clean documents and ever more junk: symbols on words, or shouting."""
    rng = random.Random(int(share * 100))
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]

    def text(n):
        line = [rng.choice(words).capitalize() if rng.random() < 0.08 else rng.choice(words) for _ in range(n)]
        return " ".join(w + ("*" if rng.random() < 0.004 else "") + ("\n" if rng.random() < 0.05 else "") for w in line)

    rows, junk = [], int(700 * share / (1 - share))
    for source, spoil in (("a", lambda t: " ".join(f"**{w}**" if rng.random() < 0.6 else w for w in t.split(" "))), ("b", str.upper)):
        rows += [(len(rows) + i, "en", source, text(rng.randrange(30, 400)), True) for i in range(700)]
        rows += [(len(rows) + i, "en", source, spoil(text(rng.randrange(30, 400))), False) for i in range(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, fine boolean")
    measured = quality.measure(docs, keep_text=False).cache()
    got = quality.judge(measured, quality.fit(measured)).collect()
    assert {r.level for r in got} == {0}
    assert sum(not r.kept for r in got if r.fine) <= 0.01 * 1400
    assert sum(not r.kept for r in got if not r.fine) >= 0.95 * 2 * junk


def test_quality_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({c: F.lit(c) for c in ("x0", "x1__", "mu", "inv", "d__", "fit__", "failed__", "start")})
    measured = quality.measure(docs, keep_text=False)
    got = quality.judge(measured, quality.fit(measured))
    assert got.where("x0 = 'x0' AND mu = 'mu' AND inv = 'inv' AND d__ = 'd__' AND x1__ = 'x1__' AND fit__ = 'fit__' AND start = 'start'").count() == docs.count()
    assert got.columns[-5:] == ["base_failed", "distance", "kept", "level", "still"]


def test_covariances_are_regular():
    var = np.array([1.0, 4.0, 0.01])
    assert np.allclose(quality.regular(np.diag(var), var), np.diag(var))
    flat = quality.regular(np.diag([1.0, 4.0, 0.0]), var)
    w = np.linalg.eigvalsh(flat / np.sqrt(np.outer(var, var)))
    assert 0 < w[-1] <= quality.CONDITION * w[0]


def test_quality_rejects_duplicate_lines_alone(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(i, "en", "s", " ".join(r.choice(words) for _ in range(200))) for i in range(200)]
    rows.append((-1, "en", "s", "\n".join(r.choice(words[:10]) for _ in range(200))))  # 95 % of the lines, few windows twice
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).cache()
    got = {x.doc_id: x for x in quality.judge(measured, quality.fit(measured)).collect()}
    assert got[-1].n_dup_lines == 190 and not got[-1].base_failed and not got[-1].kept
    assert all(x.kept for i, x in got.items() if i >= 0)


def test_sha_and_crc_of_the_contracts(spark):
    r = spark.range(1).select(F.sha2(F.lit("é"), 256).alias("s"), F.crc32(F.lit("42").cast("binary")).alias("c")).first()
    assert r.s == sha256("é".encode()).hexdigest() and r.c == zlib.crc32(b"42")
