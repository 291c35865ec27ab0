import base64
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, queries, token_counts, warc
from tidemark.llm.queries import ADDED, tokenizer_path

PIECES = [*" \n\t\r  ab1é'sß,.!|<>\x85\xa0日😀̈", "<|endoftext|>", " the", "'ll", "tion"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def test_counts_and_prefixes_are_the_librarys(library):
    c, r = token_counts.counter(tokenizer_path()), random.Random(5)
    for _ in range(400):
        s = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14)))
        assert c.count(s) == library(s), s
        want = [library(s[:i]) for i in range(len(s) + 1)]
        assert c.prefixes(s).tolist() == want and c.table(s).tolist() == want, s


def test_counts_of_documents(spark, library):
    texts = [None, "", "x" * 3000, " ".join(map(str, range(3000))), "<|endoftext|><|endoftext|>"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "n": F.lit(1)})
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, tokenizer_path(), keep_text=False).collect()}
    assert got == {i: library(t or "") for i, t in enumerate(texts)}
    assert token_counts.token_counts(docs.limit(0), tokenizer_path()).count() == 0


def test_tables_of_documents_are_those_of_prefixes(spark):
    c = token_counts.counter(tokenizer_path())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert all((c.table(t or "") == c.prefixes(t or "")).all() for t in texts)


def test_budgets_of_op9(spark, library):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 1024)
        assert library(t[: r.chars_within]) <= 1024 and (r.chars_within == len(t)) != r.over_limit


def test_truncation_by_stored_counts(spark, library):
    docs = spark.createDataFrame([(1, "The theory of  counting, told twice."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_tokens) for r in token_counts.truncate(docs, tokenizer_path(), 4).collect()}
    text = "The theory of  counting, told twice."
    best = max(i for i in range(len(text) + 1) if library(text[:i]) <= 4)
    assert got == {1: (text[:best], library(text)), 2: (None, 0)}
    assert token_counts.longest_within([0, 1, 3, 2, 4], 2) == 3


def test_escapes_are_reversible():
    r = random.Random(2)
    for _ in range(2000):
        s = "".join(r.choice(["<", "|", "\\", "<|turn|>", "<|endoftext|>", "x", "\n"]) for _ in range(r.randint(0, 9)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and "<|" not in e


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|done|>"), (1, 1, "assistant", " lead\\ and <|turn|>trail \n"), (1, 1, "assistant", ""), (1, None, None, None), (2, 0, "assistant", "日本 😀é"), (None, 3, "assistant", "x"), (3, 2, "b\n<|text|>", None)]
    rows += [(r[0], r[1], r[2], r[3]) for r in ADDED]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "conv": F.lit(2)})
    made = chat.format_conversations(turns, tokenizer_path())
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort()
        told = "".join(f"{role}\n{text}\n" for _, role, text in v)
        loss = "".join(text for _, role, text in v if role == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(v), hashlib.sha256(told.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(turns.limit(0), tokenizer_path()).count() == 0


def test_mask_by_binary_search():
    offsets = np.array([(0, 3), (3, 5), (5, 9), (9, 9), (9, 12)])
    assert chat.mask(offsets, [(3, 9), (9, 12)]).tolist() == [False, True, True, False, True]
    assert chat.mask(offsets, []).tolist() == [False] * 5


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, "http://c", "same"), (2, "http://c", "same"), (5, None, None), (4, "x", ""), (6, "y", "é" * 50_000), (None, "z", "same"), (7, "u\r\nWARC-Type: x", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "digest": F.lit(2)})
    manifest = warc.write(pages)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(manifest).withColumns({"page": warc.page_of(F.col("record_id")), "of": warc.page_of(F.col("refers_to"))}).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None if again else body))
    assert sorted(map(str, [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r["of"], None if r.payload is None else bytes(r.payload)) for r in got])) == sorted(map(str, want))
    bare = warc.read(warc.write(pages, min_bytes=5))
    assert {r.record_type for r in bare.collect()} == {"response"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_archive_directory(wide, monkeypatch):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("a/one", b"first member, long enough")
        z.writestr("b", b"second")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
    assert (b"PK\x06\x06" in raw.getvalue()) == wide
    a = warc.Archive(raw, len(raw.getvalue()))
    members = {m.name: m for m in a.directory()}
    assert list(members) == ["a/one", "b", "packed"]
    assert a.at(a.begin(members["a/one"]), members["a/one"].size) == b"first member, long enough"
    assert a.at(a.begin(members["b"]), members["b"].size) == b"second"
    with pytest.raises(ValueError, match="stored"):
        a.begin(members["packed"])
    with pytest.raises(ValueError, match="central"):
        warc.Archive(io.BytesIO(b"no zip"), 6).directory()


def test_damaged_payload_is_an_error():
    raw = warc.record("response", "u", b"abc", warc.payload_digest(b"abd"), "<urn:page:1>", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw)
