"""Benchmark decontamination by pigeonhole edit matching.

A test item of which a copy may have k errors is split into k + 1 pieces; a copy has at least one of them unchanged.
Piece hits are found by Aho-Corasick and verified with Myers' bit-parallel distance, along a tree over the pieces: a
node over p pieces may have p - 1 errors, so a copy always has a piece all of whose nodes hold, and most chance hits
end at the first node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Sealed

#: Characters of test items that one pass over the documents searches for at once; more items take more passes.
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    """Lower case, each run of white space as one space."""
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> int:
    """The least edit distance of a pattern of m characters to any substring of text, or most + 1 if it is over most."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, min(m, most + 1)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best


class Matcher:
    """Pieces, trees and masks for a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.items, self.short, at = items, [len(t) < min_chars for _, t in items], {}
        self.chains: list[list[list[tuple[int, int, int]]]] = []  # by item and piece: (start, end, errors) of its nodes, upward
        self.peqs: dict[tuple[int, int, int], dict[str, int]] = {}
        for n, (_, text) in enumerate(items):
            k = int(rate * len(text)) if len(text) >= min_chars else 0
            cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
            chains: list[list[tuple[int, int, int]]] = [[] for _ in range(k + 1)]
            spans = [(0, k + 1)]
            while spans:
                lo, hi = spans.pop()
                if hi - lo > 1:
                    for p in range(lo, hi):
                        chains[p].insert(0, (cuts[lo], cuts[hi], hi - lo - 1))
                    mid = (lo + hi) // 2
                    spans += [(lo, mid), (mid, hi)]
            self.chains.append(chains)
            for p in range(k + 1):
                at.setdefault(text[cuts[p] : cuts[p + 1]], []).append((n, p, cuts[p]))
        for piece, uses in at.items():
            self.auto.add_word(piece, (len(piece), uses))
        self.auto.make_automaton()

    def hits(self, text: str) -> dict[int, int]:
        """item number -> least distance, of the items that text has a copy of."""
        found: dict[int, int] = {}
        failed: set[tuple[int, int, int, int]] = set()
        for end, (n_chars, uses) in self.auto.iter(text):
            for n, p, offset in uses:
                if found.get(n, 1) == 0:
                    continue
                base = end + 1 - n_chars - offset  # where the item would begin
                if self.short[n] and (text[max(0, base - 1) : base] not in ("", " ") or text[end + 1 : end + 2] not in ("", " ")):
                    continue
                for a, b, e in self.chains[n][p]:
                    if (n, a, b, base) in failed:
                        break
                    peq = self.peqs.get((n, a, b))
                    if peq is None:
                        peq = self.peqs[(n, a, b)] = masks(self.items[n][1][a:b])
                    d = myers(peq, b - a, text[max(0, base + a - e) : base + b + e], e)
                    if d > e:
                        failed.add((n, a, b, base))
                        break
                else:
                    d = d if self.chains[n][p] else 0
                    found[n] = min(d, found.get(n, d))
        return found


_matchers: dict[int, Matcher] = {}


def _search(items: list[tuple[int | None, str]], rate: float, min_chars: int):
    key = hash((tuple(items), rate, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items, rate, min_chars)
        m = _matchers[key]
        for b in batches:
            docs, ids, dists = [], [], []
            for i, t in enumerate(b.column(1)):
                for n, d in m.hits(normal(t.as_py() or "")).items():
                    docs.append(i)
                    ids.append(items[n][0])
                    dists.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(ids, pa.int64()), pa.array(dists, pa.int32())], names=["doc", "item_id", "distance"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size: they are the query set, and come one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        t = normal(r["t"])
        if not t:
            continue
        block.append((r["i"], t))
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, distance): one row for each document and test item of which it has a copy, whole texts searched.

    A copy has at most rate * length edits, counted in characters of lower-case text with single spaces. Items of fewer
    than min_chars characters, for which that comes to none, are found where they stand unchanged between white space or
    the ends. If id_col is 'item_id', the items' column is 'test_item_id'. Null and empty items aren't searched for; an item's id may be null.
    A null text is empty and has no copies. Rows that share an id and repeated rows give one row with the least distance.
    """
    s = Sealed(docs, id_col, text_col)
    pairs = s.df.select(s[id_col].alias("doc"), s[text_col].alias("text"))
    kind = pairs.schema["doc"].dataType
    schema = StructType([StructField("doc", kind), StructField("item_id", LongType()), StructField("distance", IntegerType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text):
        out = out.unionByName(pairs.mapInArrow(_search(block, rate, min_chars), schema))
    least = out.groupBy("doc", "item_id").agg(F.min("distance").alias("distance"))
    return least.toDF(id_col, "test_item_id" if id_col == "item_id" else "item_id", "distance")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that have a copy of a test item. Found and dropped in the same pass, without a join."""
    s = Sealed(docs, text_col)
    out, text = s.df, s.inner[text_col]
    for block in _blocks(benchmark, item_col, item_text):
        out = out.mapInArrow(_filter(block, rate, min_chars, out.columns.index(text)), out.schema)
    return s.replace(out)


def _filter(items: list[tuple[int | None, str]], rate: float, min_chars: int, at: int):
    key = hash((tuple(items), rate, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items, rate, min_chars)
        m = _matchers[key]
        for b in batches:
            yield b.filter(pa.array([not m.hits(normal(t.as_py() or "")) for t in b.column(at)], pa.bool_()))

    return run
