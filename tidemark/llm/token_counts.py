"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

Each pre-token is solved once by dynamic programming over its bytes: the last token of a prefix is the one whose
pairing with the last token before it survives the merges, so the count at a byte is the count before that token plus
one. Counts of a text are sums over its pre-tokens; a prefix needs its pre-token's row of the table and no encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import Sealed

# The pre-token pattern of byte-level BPE, its classes written out for the code points below U+0250.
_W, _L, _N = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_FAR = re.compile("[^\\x00-\\u024f]")
#: A space that a run of white space may take: where there is none, a space begins a pre-token.
_RUN = re.compile(f" (?=[{_W}])|(?<=[{_W}]) ")
#: Two of white space: a prefix that ends between them takes them whole.
_TWO = re.compile(f"[{_W}]{{2}}")
#: Solved strings kept by a worker; beyond it, it starts anew.
MEMO = 1_200_000
#: Bytes of the longest prefix of a pre-token that is kept, characters of the longest word.
KEPT = 64
#: Tables of bytes that add a number.
_PLUS = [bytes(min(255, i + n) for i in range(256)) for n in range(256)]


class Counter:
    """Counts for the vocabulary of a tokenizers .json file with a ByteLevel pre-tokenizer and BPE."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        if j["model"]["type"] != "BPE" or j["pre_tokenizer"]["type"] != "ByteLevel" or j["pre_tokenizer"].get("add_prefix_space") or j["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary is needed, without normalizer or prefix space")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        raw = lambda t: bytes(self.byte[c] for c in t)
        added = [a["content"] for a in j["added_tokens"]]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.vocab = {raw(t) for t in j["model"]["vocab"] if t not in set(added)}
        self.longest = max(map(len, self.vocab))
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.born: dict[bytes, int] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for (a, b), i in self.rank.items():
            if a + b not in self.born:
                self.born[a + b], self.halves[a + b] = i, (a, b)
        self.whole: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.tokens: dict[bytes, int] = {}
        self.chunks: dict[str, int] = {}
        self.sizes: dict[bytes, int] = {}
        self.rows: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def merged(self, b: bytes) -> list[bytes]:
        """b merged by rank, the lowest first and from the left; for the short strings of two tokens."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def alone(self, t: bytes) -> bool:
        """Whether the merges make t of its bytes."""
        if (ok := self.whole.get(t)) is None:
            ok = self.whole[t] = self.merged(t) == [t]
        return ok

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave tokens a and b side by side.

        Going back in time, the token merged later comes apart first; at each stage the two parts at the seam must have
        no merge that would have come before. Of equal merges the left one comes first.
        """
        if (known := self.pairs.get((a, b))) is not None:
            return known
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        rank, born, halves, limit, pair, ok = self.rank, self.born, self.halves, 1 << 30, (a, b), None
        while ok is None:
            if rank.get((a, b), limit) < limit:
                ok = False
                break
            x, y = born.get(a, -1), born.get(b, -1)
            if x > y:
                limit, a = x, halves[a][1]
            elif y >= 0:
                limit, b = y + 1, halves[b][0]
            else:
                ok = True
        self.pairs[pair] = ok
        return ok

    def row(self, b: bytes) -> list[int]:
        """The table of one pre-token: the token count of each prefix of its bytes.

        The last token of a prefix doesn't depend on what comes after it: its size is kept for all pre-tokens that begin
        with the prefix, so that only the others are solved.
        """
        known, size, count, vocab, fits, alone, most = self.sizes, [0], [0], self.vocab, self.fits, self.alone, self.longest
        for i in range(1, len(b) + 1):
            n = known.get(b[:i]) if i <= KEPT else None
            if n is None:
                for a in range(max(0, i - most), i):
                    t = b[a:i]
                    if t in vocab and (fits(b[a - size[a] : a], t) if a else alone(t)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                n = i - a
                if i <= KEPT:
                    if len(known) >= MEMO:
                        known.clear()
                    known[b[:i]] = n
            size.append(n)
            count.append(count[i - n] + 1)
        return count

    def _token(self, b: bytes) -> int:
        if (n := self.tokens.get(b)) is None:
            if len(self.tokens) >= MEMO:
                self.tokens.clear()
            n = self.row(b)[-1]
            if len(b) <= 64:
                self.tokens[b] = n
        return n

    def pretokens(self, s: str) -> list[str]:
        """The pre-tokens of a stretch without added tokens."""
        if _FAR.search(s):
            return [s[a:b] for _, (a, b) in self.pre.pre_tokenize_str(s)] if s else []
        return _SPLIT.findall(s)

    def _plain(self, s: str) -> int:
        if not s:
            return 0
        if _FAR.search(s) or _RUN.search(s):
            return sum(self._token(t.encode()) for t in self.pretokens(s))
        known, head, *rest = self.chunks, *s.split(" ")
        n = sum(self._token(t.encode()) for t in _SPLIT.findall(head))
        for piece in rest:
            c = known.get(piece)
            if c is None:
                if len(known) >= MEMO:
                    known.clear()
                c = sum(self._token(t.encode()) for t in _SPLIT.findall(" " + piece))
                if len(piece) <= 64:
                    known[piece] = c
            n += c
        return n

    def stretches(self, s: str) -> Iterator[tuple[int, str, bool]]:
        """(offset, stretch, whether it is an added token)."""
        at = 0
        for m in self.added.finditer(s) if self.added else ():
            if m.start() > at:
                yield at, s[at : m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        if at < len(s):
            yield at, s[at:], False

    def count(self, s: str) -> int:
        return sum(1 if added else self._plain(x) for _, x, added in self.stretches(s)) if self.added and self.added.search(s) else self._plain(s)

    def prefixes(self, s: str) -> np.ndarray:
        """The exact token count of s[:i] for each i from 0 to len(s)."""
        out = np.zeros(len(s) + 1, np.int32)
        base = 0
        for at, x, added in self.stretches(s):
            if added:  # its own prefixes are plain text, whose white space before it stays as it was
                for i in range(1, len(x)):
                    out[at + i] = self._tail(s, out, at + i)
                base += 1
                out[at + len(x)] = base
                continue
            p = 0
            for t in self.pretokens(x):
                row, b = self.row(t.encode()), 0
                for i, c in enumerate(t, 1):
                    b += len(c.encode())
                    out[at + p + i] = base + row[b]
                # A prefix that ends in white space takes a run of it whole, where the text leaves one for a word.
                if p and x[p - 1].isspace():
                    for i in range(1, len(t) + 1):
                        if not t[:i].isspace():
                            break
                        out[at + p + i] = self._tail(s, out, at + p + i)
                base += row[-1]
                p += len(t)
        return out

    def _solved(self, t: str) -> bytes:
        """The counts of t[:1], t[:2] to t, a pre-token; kept with the words where it begins with a space."""
        known, key = (self.rows, t[1:]) if t[0] == " " else (self.bare, t)
        row = known.get(key)
        if row is None:
            b = t.encode()
            row = bytes(self.row(b)[1:])
            if len(b) > len(t):
                row = bytes(n for n, after in zip(row, b[1:] + b"a") if after & 0xC0 != 0x80)
            if len(known) >= MEMO:
                known.clear()
            known[key] = row
        return row

    def _word(self, s: str) -> bytes:
        """prefixes(s) without its first, as bytes, for a short stretch without added tokens and far characters."""
        if _TWO.search(s):
            return self.prefixes(s)[1:].astype(np.uint8).tobytes()
        out, base = b"", 0
        for t in _SPLIT.findall(s):
            row = self._solved(t)
            out += row.translate(_PLUS[base]) if base else row
            base += row[-1]
        return out

    def _rows(self, s: str) -> list[bytes] | None:
        """The tables of a text's words, where no run of white space crosses them and each is short."""
        if not s or _FAR.search(s) or _RUN.search(s) or (self.added and self.added.search(s)):
            return None
        known, head, *rest = self.rows, *s.split(" ")
        if len(head) > KEPT:
            return None
        rows = [b"\0" + self._word(head), *map(known.get, rest)]
        if None in rows:
            for i, row in enumerate(rows):
                if row is None:
                    piece = rest[i - 1]
                    row = known.get(piece)
                    if row is None:
                        if len(piece) > KEPT:
                            return None  # counts of a word are held as bytes
                        row = self._word(" " + piece)
                        if len(known) >= MEMO:
                            known.clear()
                        known[piece] = row
                    rows[i] = row
        return rows

    @staticmethod
    def _laid(rows: list[bytes]) -> np.ndarray:
        flat = np.frombuffer(b"".join(rows), np.uint8)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        n = flat[np.cumsum(size) - 1].astype(np.int32)
        return flat + np.repeat(np.cumsum(n, dtype=np.int32) - n, size)

    def table(self, s: str) -> np.ndarray:
        """prefixes(s), put together from the tables of its words where it can be."""
        rows = self._rows(s)
        return self.prefixes(s) if rows is None else self._laid(rows)

    def within(self, s: str, budget: int) -> tuple[int, int]:
        """The last entry of table(s), and the length of the longest prefix of at most budget tokens.

        The words' tables are laid out only where the text has more, and only up to the word after which no prefix fits.
        """
        rows = self._rows(s)
        if rows is None:
            t = self.prefixes(s)
            return int(t[-1]), longest_within(t, budget)
        ends = [r[-1] for r in rows]
        n = sum(ends)
        if n <= budget:
            return n, len(s)
        k = base = 0
        while base <= budget:
            base += ends[k]
            k += 1
        return n, longest_within(self._laid(rows[:k]), budget)

    def _tail(self, s: str, out: np.ndarray, end: int) -> int:
        """The count of s[:end], from the last place before it that no longer pre-token can cross."""
        a = max(0, end - 1)
        while a > 0 and not (not s[a - 1].isspace() and s[a].isspace()):
            a -= 1
        return self.count(s[:end]) if a == 0 else int(out[a]) + self.count(s[a:end])


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = True, prefixes: bool = False, budget: int | None = None) -> DataFrame:
    """docs plus n_tokens (long) and, if asked for, prefix_tokens (array<int>, one more than the text has characters), or
    for a budget of tokens chars_within (the length of the longest prefix within it) and over_budget.

    Counts are those of the tokenizers library for the vocabulary at path, which is a path on every executor: without
    begin, end or added tokens; the strings of added tokens inside a text are one token. A null text counts as empty,
    with 0 tokens. New columns replace those of the same name. Rows stay as many, repeated ones included.
    """
    s = Sealed(docs, text_col)
    text = s.inner[text_col]
    df = s.df.withColumn("text__", F.coalesce(F.col(text), F.lit("")))
    if not keep_text:
        df = df.drop(text)
    carried = [f for f in df.schema.fields if f.name != "text__"]
    new = [StructField("n__", LongType())] + [StructField("p__", ArrayType(IntegerType()))] * prefixes
    new += [StructField("w__", LongType()), StructField("o__", BooleanType())] * (budget is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = b.column("text__")
            if prefixes or budget is not None:
                n, stored, within, over = [], [], [], []
                for x in texts:
                    s = x.as_py()
                    if prefixes:
                        t = c.table(s)
                        n.append(int(t[-1]))
                        stored.append(t.astype(np.int32))
                        if budget is not None:
                            within.append(longest_within(t, budget))
                    else:
                        whole, fits = c.within(s, budget)
                        n.append(whole)
                        within.append(fits)
                    if budget is not None:
                        over.append(within[-1] < len(s))
                cols = [pa.array(n, pa.int64())] + [pa.array(stored, pa.list_(pa.int32()))] * prefixes
                cols += [pa.array(within, pa.int64()), pa.array(over, pa.bool_())] * (budget is not None)
            else:
                cols = [pa.array([c.count(x.as_py()) for x in texts], pa.int64())]
            kept = [b.column(f.name) for f in carried]
            yield pa.RecordBatch.from_arrays(kept + cols, names=[f.name for f in carried + new])

    out = df.mapInArrow(run, StructType(carried + new))
    made = {"n_tokens": F.col("n__")} | ({"prefix_tokens": F.col("p__")} if prefixes else {})
    made |= {"chars_within": F.col("w__"), "over_budget": F.col("o__")} if budget is not None else {}
    old = [F.col(s.inner[n]).alias(n) for n in s.names if n not in made and (keep_text or n != text_col)]
    return out.select(*old, *[c.alias(n) for n, c in made.items()])


def longest_within(prefix_tokens, budget: int) -> int:
    """The length of the longest prefix of at most budget tokens, from its stored counts."""
    within = np.flatnonzero(np.asarray(prefix_tokens) <= budget)
    return int(within[-1]) if len(within) else 0


def truncate(docs: DataFrame, path: str, budget: int, text_col: str = "text") -> DataFrame:
    """docs with each text cut to its longest prefix of at most budget tokens, plus n_tokens of the whole text.

    Answered from the stored counts; nothing is encoded again. A null text stays null.
    """
    counted = token_counts(docs, path, text_col=text_col, prefixes=True)
    fits = F.filter(F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull())
    return counted.withColumn(text_col, F.col(text_col).substr(F.lit(1), F.array_max(fits))).drop("prefix_tokens")

