"""A hierarchical Pitman-Yor language model over words.

Every word of the training texts, and the start of a text, is a context with a restaurant of its own for the words that
follow it; all of them share one parent restaurant, whose base is uniform over the training words and one unknown word.
The customers of the parent are the tables of the contexts. Tables are sampled by Gibbs: a dish's customers are seated
one after the other given the other dishes' tables and the parent's probability, all dishes of a sweep at the same
time. The tables of the kept sweeps are averaged, in both levels over the same sweeps, so the predictive probabilities
of each context sum to one.

Texts are held as blocks of word numbers. What a block has to tell or to ask about its distinct words and pairs of
words goes to shards, by hash: a shard gets at most one entry of a word or pair from a block, however frequent it is, so
no key makes a shard large. Words and pairs are known by 64-bit hashes. A pair that occurs once has one table in every
sweep; only the others ("dishes") are held for sampling, in the first block that has them. Once counted, a dish is known
by its shard and its place among the shard's dishes, which takes less room than its hash.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sealed

#: Tokens in a block. Customers of a dish that are seated one by one; those beyond come in runs, a RUN-th of those before.
BLOCK, EXACT, RUN = 2_000_000, 128, 16
STRENGTH = 1.0
#: The start of a text, which is a context only, and its end, which is a token: words have no white space.
START, END = b"\n", b" "
#: Order of a block's rows: what came back from the shards, and then the block.
COUNTED, WORDS, DISHES, PAIRS, WHOLE = range(5)
U64 = np.uint64
_ROW = "kind int, shard int, block long, keys binary, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte by byte of their items: small numbers leave hardly anything."""
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head + b"".join(body), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(raw)
    kinds = [struct.unpack_from("<cI", raw, 1 + 5 * i) for i in range(raw[0])]
    out, at = [], 1 + 5 * len(kinds)
    for char, n in kinds:
        dtype = np.dtype(char.decode())
        part = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw)[0], dtype=U64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else U64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, good in all its bits."""
    x = (a ^ (a >> U64(31))) * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _ranked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, the number of each item's value, the first item of each value)."""
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    group = np.empty(len(flat), np.int64)
    group[order] = np.cumsum(new) - 1
    return s[new], group, order[new]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Block:
    """Texts as word numbers. flags: 1 for a training text, 2 for a null id. words: the hash of each number."""

    docs: np.ndarray
    flags: np.ndarray
    lens: np.ndarray
    ids: np.ndarray
    words: np.ndarray

    @property
    def train(self) -> np.ndarray:
        """By token, ends included."""
        return np.repeat((self.flags & 1).astype(np.int64), self.lens + 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys of the distinct pairs, sorted; their contexts; their words; the pair of each token)."""
        first = np.cumsum(self.lens + 2) - (self.lens + 2)
        flat = np.empty(len(self.ids) + 2 * len(self.lens), np.int64)
        inner = np.ones(len(flat), bool)
        last = first + self.lens + 1
        inner[first] = inner[last] = False
        flat[first], flat[last], flat[inner] = 0, 1, self.ids
        at = np.ones(max(0, len(flat) - 1), bool)
        at[last[:-1]] = False
        one = flat[:-1][at] * len(self.words) + flat[1:][at]
        seen, pair = np.unique(one, return_inverse=True)
        u, w = np.divmod(seen, len(self.words))
        keys = _mix(self.words[u], self.words[w])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return keys[order], u[order], w[order], place[pair.reshape(-1)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks."""
    from pyspark import TaskContext
    from xxhash import xxh3_64_intdigest as digest

    part, seq = TaskContext.get().partitionId(), 0

    def close():
        nonlocal seq
        if seq >= 1 << 20:
            raise ValueError("a partition is too large for the number of its block")
        words = np.fromiter(map(digest, number), U64, len(number))
        flat = np.concatenate(arrays)
        lens = np.array([len(a) for a in arrays], np.uint32)
        ids = np.array([d or 0 for d in docs], np.int64)
        flags = np.array([t | (d is None) << 1 for d, t in zip(docs, train, strict=True)], np.uint8)
        whole = pa.array([_pack(ids, flags, lens, flat, words)], pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array([part << 20 | seq], pa.int64()), whole], names=["block", "data"])
        seq += 1
        return out

    fresh = lambda: (_Numbers({START: 0, END: 1}), [], [], [], 0)
    number, arrays, docs, train, size = fresh()
    for b in batches:
        for doc, text, learn in zip(b.column("doc").to_pylist(), b.column("text"), b.column("train").to_pylist(), strict=True):
            words = text.as_py().lower().split()
            arrays.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
            docs.append(doc)
            train.append(learn)
            size += len(words) + 1
            if size >= BLOCK:
                yield close()
                number, arrays, docs, train, size = fresh()
    if docs:
        yield close()


def _block(raw: bytes) -> Block:
    docs, flags, lens, ids, words = _unpack(raw)
    return Block(docs, flags, lens.astype(np.int64), ids.astype(np.int64), words)


def _rows(kind: int, block: int, bits: int, keys: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their columns as a row for each shard that has any."""
    shard = (keys >> U64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    blobs = [_pack(*[c[a:b] for c in cols]) if cols else None for a, b in cuts]
    n = len(cuts)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(shard[edges[:-1]].astype(np.int32)), pa.array(np.full(n, block, np.int64))]
    columns += [pa.array([_pack_keys(keys[a:b]) for a, b in cuts], pa.binary()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "shard", "block", "keys", "data"])


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "shard": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "data": pa.binary(), "sums": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)], names=list(names))


def _grouped(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """Sorted rows by key, one key's at a time."""
    last, held = None, []
    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in (key, *names)), strict=True):
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append(tuple(row))
    if held:
        yield last, held


def _ask_pairs(bits: int):
    """Blocks to their distinct pairs with their training counts, by shard of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, raw in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                block = _block(raw.as_py())
                keys, _, _, pair = block.pairs()
                yield _rows(PAIRS, number, bits, keys, _small(np.bincount(pair, block.train, len(keys))))

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each asked pair's count over all blocks, times two, plus one in the first block that trains on it; and for those
    that occur twice or more, their places among the shard's such pairs, as steps."""
    for shard, rows in _grouped(batches, "shard", "block", "keys", "data"):
        asked = [_unpack_keys(k) for _, k, _ in rows]
        n = np.concatenate([_unpack(d)[0] for _, _, d in rows]).astype(np.int64)
        kinds, group, _ = _ranked(np.concatenate(asked))
        total = np.bincount(group, n, len(kinds)).astype(np.int64)
        place = np.cumsum(total > 1) - 1
        out = total[group] * 2
        have = np.flatnonzero(n)
        _, _, first = _ranked(group[have])
        out[have[first]] += 1
        ends, back = np.cumsum([len(k) for k in asked]), []
        for (block, _, _), x, g in zip(rows, np.split(out, ends[:-1]), np.split(group, ends[:-1]), strict=True):
            back.append((COUNTED, shard, block, _pack(_small(x), _small(np.diff(place[g[x > 3]], prepend=0)))))
        yield _batch(back, "kind", "shard", "block", "data")


def _counted(bits: int):
    """Blocks with their pairs' counts to: the counts; sums by word (tokens, customers as a context, kinds of pairs as a
    context and as a word); the dishes that the block holds; and the asked pairs that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches, "block", "kind", "shard", "data"):
            block = _block(rows[-1][2])
            answers = [(U64(shard) << U64(64 - bits), *_unpack(d)) for k, shard, d in rows if k == COUNTED]
            told = np.concatenate([a[1] for a in answers]).astype(np.int64)
            dish = np.concatenate([a[0] + np.cumsum(a[2], dtype=U64) for a in answers])
            keys, u, w, pair = block.pairs()
            if len(told) != len(keys):
                raise ValueError("a block's counts aren't whole")
            n, own = told >> 1, told & 1
            here, size = np.bincount(pair, block.train, len(keys)), len(block.words)
            sums = [_small(np.bincount(i, x, size)) for i, x in ((w, here), (u, here), (u, own), (w, own))]
            order = np.argsort(block.words)
            yield _rows(WORDS, number, bits, block.words[order], *[s[order] for s in sums])
            yield _rows(PAIRS, number, bits, dish)
            some = (own > 0) & (n > 1)
            names = np.sort(block.words[np.unique(np.r_[u[some], w[some]])])
            ends = [np.searchsorted(names, block.words[x[some]]).astype(np.uint32) for x in (u, w)]
            held = _pack(names, np.diff(dish[own[n > 1] > 0], prepend=U64(0)), *ends, _small(n[some]), np.ones(some.sum(), np.uint32))
            few = [int(((own > 0) & (n == k)).sum()) for k in (1, 2)]
            yield _batch([(COUNTED, few[0], number, None, _pack(_small(n))), (DISHES, few[1], number, None, held)], "kind", "shard", "block", "keys", "data")

    return run


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all blocks, a row per shard; and what is summed over all words: words, tokens, pairs, words in one and in two kinds of pairs."""
    for shard, rows in _grouped(batches, "shard", "keys", "data"):
        kinds, group, _ = _ranked(np.concatenate([_unpack_keys(k) for k, _ in rows]))
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*(_unpack(d) for _, d in rows), strict=True)]
        sums = [np.bincount(group, c, len(kinds)).astype(np.int64) for c in cols]
        as_word = sums[3]
        told = [float((sums[0] > 0).sum()), float(sums[0].sum()), float(as_word.sum()), float((as_word == 1).sum()), float((as_word == 2).sum())]
        yield _batch([(shard, -1, _pack_keys(kinds), _pack(*map(_small, sums)), told)], "shard", "block", "keys", "data", "sums")


@dataclass
class Totals:
    """Training words, tokens and discounts; customers and tables of the parent restaurant."""

    kinds: int
    tokens: int
    child: float
    parent: float
    customers: float
    tables: float

    @property
    def base(self) -> float:
        """What a word without customers gets from the parent."""
        return (STRENGTH + self.parent * self.tables) / (STRENGTH + self.customers) / (self.kinds + 1)

    def own(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What the parent gives a word of n customers at t tables beyond the base."""
        return (n - self.parent * t) / (STRENGTH + self.customers)

    def seat(self, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of the parent's dishes."""
        a = self.parent / (self.kinds + 1)
        return seat(n, np.full(len(n), STRENGTH / (self.kinds + 1) + a * max(0.0, self.tables - 1)), np.full(len(n), a), self.parent, rng)


def seat(n: np.ndarray, mass: np.ndarray, growth: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of n customers who come one after the other.

    A customer takes a new table with a weight of mass, plus growth for each table that the dish has, and else an old
    one, with a weight of the customers there less d for each table. Beyond EXACT customers a run of them comes at a
    time, with the chance at its middle.
    """
    t = np.minimum(n, 1).astype(np.int64)
    order = np.argsort(-n.astype(np.int64), kind="stable")
    m, mass, growth, x = n[order].astype(np.int64), mass[order], growth[order], t[order]
    more = lambda j: int(np.searchsorted(-m, -j))  # noqa: E731  dishes of over j customers: they come first
    for j in range(1, EXACT):
        if not (k := more(j)):
            break
        new = mass[:k] + growth[:k] * x[:k]
        x[:k] += rng.random(k) * (new + j - d * x[:k]) < new
    j = EXACT
    while k := more(j):
        run = np.minimum(j // RUN, m[:k] - j)
        chance = lambda y, at, k=k: (a := mass[:k] + growth[:k] * y) / (a + at - d * y)
        half = chance(x[:k], j)
        x[:k] += rng.binomial(run, np.clip(chance(x[:k] + half * run / 2, j + run / 2), 0, 1))
        j += j // RUN
    t[order] = x
    return t


def _dish_sums(bits: int, kept: int = 0):
    """Dishes to what their tables add to their contexts and words, by shard of the word; kept: each of the last sweeps'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, raw in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                names, _, u, w, _, *tables = _unpack(raw.as_py())
                more = [t.astype(np.int64) - 1 for t in tables[-max(kept, 1) :]]
                as_word = [_small(np.bincount(w, x, len(names))) for x in more]
                yield _rows(DISHES, number, bits, names, _small(np.bincount(u, sum(more), len(names))), *as_word)

    return run


def _tables_now(state: tuple, rows: list[tuple], kept: int = 1) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(keys, sums by word, [tables as a context, then customers in the parent by sweep], the place of each row's keys)."""
    keys, sums = _unpack_keys(state[0]), [x.astype(np.int64) for x in _unpack(state[1])]
    now = [sums[2] * kept] + [sums[3].copy() for _ in range(kept)]
    places = []
    for k, d in rows:
        places.append(np.searchsorted(keys, _unpack_keys(k)))
        for total, more in zip(now, _unpack(d), strict=True):
            total[places[-1]] += more.astype(np.int64)
    return keys, sums, now, places


def _parents(totals: Totals, turn: int):
    """A shard's words with the tables of their dishes, to the tables of each context and the parent's probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard", "block", "keys", "data"):
            _, _, (tables, guests), places = _tables_now(rows[0][1:], [r[1:] for r in rows[1:]])
            held = totals.seat(guests, np.random.default_rng([turn, shard]))
            p = totals.own(guests, held) + totals.base
            out = [(WORDS, shard, r[0], _pack(_small(tables[at]), p[at])) for r, at in zip(rows[1:], places, strict=True)]
            out.append((WORDS, shard, -1, _pack(np.array([held.sum()], np.int64))))
            yield _batch(out, "kind", "shard", "block", "data")

    return run


def _reseat(totals: Totals, turn: int, keep: bool):
    """Dishes and the answers for their words to dishes with new tables, which replace the last ones unless those are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches, "block", "kind", "data"):
            answers = [_unpack(d) for k, d in rows if k == WORDS]
            if number < 0:
                yield _batch([(number, None, [0.0, float(sum(a[0][0] for a in answers))])], "block", "data", "sums")
                continue
            names, dish, u, w, n, *tables = _unpack(next(d for k, d in rows if k == DISHES))
            new = tables[-1]
            if len(names):
                of, p = (np.concatenate(x) for x in zip(*answers, strict=True))
                if len(of) != len(names):
                    raise ValueError("a block's answers aren't whole")
                others = of[u].astype(np.int64) - tables[-1]
                new = seat(n, (STRENGTH + totals.child * others) * p[w], totals.child * p[w], totals.child, np.random.default_rng([turn, number]))
            tables = [*(tables if keep else tables[:-1]), _small(new)]
            yield _batch([(number, _pack(names, dish, u, w, n, *tables), [float(new.sum() - len(new)), 0.0])], "block", "data", "sums")

    return run


def _means(sweeps: list[Totals], turn: int):
    """A shard's words to: tokens, customers as a context, tables as a context over all kept sweeps, and the parent's
    probability beyond the base, averaged; sums: the parent's tables in each sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard", "keys", "data"):
            keys, sums, (tables, *guests), _ = _tables_now(rows[0], rows[1:], len(sweeps))
            held = [s.seat(g, np.random.default_rng([turn + i, shard])) for i, (s, g) in enumerate(zip(sweeps, guests, strict=True))]
            own = sum(s.own(g, t) for s, g, t in zip(sweeps, guests, held, strict=True)) / len(sweeps)
            data = _pack(_small(sums[0]), _small(sums[1]), _small(tables), own)
            yield _batch([(shard, -1, _pack_keys(keys), data, [float(t.sum()) for t in held])], "shard", "block", "keys", "data", "sums")

    return run


def _dish_tables(bits: int, kept: int):
    """Dishes to their tables over all kept sweeps, by shard of the dish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("data"):
                _, dish, _, _, _, *tables = _unpack(raw.as_py())
                yield _rows(DISHES, -1, bits, np.cumsum(dish, dtype=U64), _small(sum(t.astype(np.int64) for t in tables[-kept:])))

    return run


def _answers(kind: int):
    """What a shard knows (the rows of block -1), to each block's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard", "block", "keys", "data"):
            known = [r for r in rows if r[0] < 0]
            keys = np.concatenate([_unpack_keys(k) for _, k, _ in known]) if known else np.zeros(0, U64)
            cols = [np.concatenate(x) for x in zip(*(_unpack(d) for *_, d in known), strict=True)]
            keys, _, first = _ranked(keys)
            cols = [c[first] for c in cols]
            out = []
            for block, asked, _ in rows[len(known) :]:
                asked = _unpack_keys(asked)
                at = np.searchsorted(keys, asked)
                if not len(keys) or at.max() >= len(keys) or (keys[at] != asked).any():
                    raise ValueError("a shard lacks a key that is asked for")
                out.append((kind, shard, block, _pack(*[c[at] for c in cols])))
            if out:
                yield _batch(out, "kind", "shard", "block", "data")

    return run


def _scores(totals: Totals, base: float, kept: int, each: bool):
    """A block and its answers to a row per text."""
    least = math.log10(totals.tokens + totals.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "block", "kind", "data"):
            parts = {k: [_unpack(d) for kind, d in rows if kind == k] for k in (COUNTED, WORDS, PAIRS)}
            block = _block(rows[-1][1])
            _, u, w, pair = block.pairs()
            n = parts[COUNTED][0][0].astype(np.int64)
            order = np.argsort(block.words)
            cols = [np.empty(len(order)) for _ in range(4)]
            for c, x in zip(cols, zip(*parts[WORDS], strict=True), strict=True):
                c[order] = np.concatenate(x)
            c, guests, tables, own = cols
            held = np.full(len(n), float(kept))
            if parts[PAIRS]:
                held[n > 1] = np.concatenate([x[0] for x in parts[PAIRS]])
            room = STRENGTH + guests
            p = np.where(n > 0, n - totals.child * held / kept, 0.0) / room[u] + ((STRENGTH + totals.child * tables / kept) / room)[u] * (own[w] + base)
            begin = np.cumsum(block.lens + 1) - (block.lens + 1)
            logs, seen = np.log10(p)[pair], c[w][pair]
            total = lambda x: np.add.reduceat(x, begin)
            out = [
                pa.array(block.docs, pa.int64(), mask=block.flags & 2 > 0),
                pa.array(block.lens + 1, pa.int64()),
                pa.array(total((seen > 0).astype(np.int64)), pa.int64()),
                pa.array(total(np.log10(seen + 1) - least), pa.float64()),
                pa.array(total(logs), pa.float64()),
            ]
            names = ["doc", "n_tokens", "n_known", "base_score", "score"]
            if each:
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(logs)], pa.int32()), pa.array(logs)))
                names.append("token_scores")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _discount(one: float, two: float) -> float:
    """Of a restaurant, from how many dishes have one customer and how many have two."""
    return float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))


def score(docs: DataFrame, learn: Column, sweeps: int = 3, burn: int = 2, id_col: str = "doc_id", text_col: str = "text", each: bool = False) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), a row per row of docs; each: token_scores as well.

    The model learns from the rows that satisfy learn, a condition on the id under the name 'doc'; null counts as false.
    A-Z in lower case, words by white space, then one end of text, which is a token. A null or empty text has only its
    end. n_known: tokens that training has. base_score: log10 of add-one unigram probabilities. score: the model's, the
    sum of token_scores; the probabilities that a context gives the training words and one unknown word sum to 1.
    Rows that share an id, or have a null one, are texts of their own. An empty table gives none; without training rows
    all words are unknown, and the one that there is has probability 1. All contexts and pairs of words are counted.
    Reruns over the same files agree. sweeps: those averaged; burn: those before them.
    """
    s = Sealed(docs, id_col, text_col)
    text = F.coalesce(s[text_col], F.lit("")).cast("binary")
    given = s.df.select(s[id_col].cast("long").alias("doc"), text.alias("text")).withColumn("train", F.coalesce(learn, F.lit(False)))
    with Scratch(docs.sparkSession, "lm") as scratch:
        blocks = scratch.store(given.mapInArrow(_blocks, "block long, data binary"), "blocks")
        # Shards grow with the blocks, so that what a shard holds doesn't.
        bits = max(6, math.ceil(math.log2(max(1, blocks.count()))))
        at_shard = lambda d, *order: d.repartition("shard").sortWithinPartitions("shard", *order)
        at_block = lambda d: d.repartition("block").sortWithinPartitions("block", "kind", "shard")
        answer, whole = "kind int, shard int, block long, data binary", F.lit(2**31 - 1).alias("shard")
        full = blocks.select(F.lit(WHOLE).alias("kind"), whole, "block", "data")

        pairs = at_shard(blocks.mapInArrow(_ask_pairs(bits), _ROW), "block").mapInArrow(_count_pairs, answer)
        counted = scratch.store(at_block(pairs.unionByName(full)).mapInArrow(_counted(bits), _ROW), "counted", by="kind")
        few = {r["kind"]: r["n"] for r in counted.where(F.col("kind").isin(COUNTED, DISHES)).groupBy("kind").agg(F.sum("shard").alias("n")).collect()}
        told = counted.where(F.col("kind") == WORDS)
        state = scratch.store(at_shard(told).mapInArrow(_word_sums, "shard int, block long, keys binary, data binary, sums array<double>"), "state")
        kinds, tokens, kinds_of_pairs, one, two = _sum(state, 5)
        totals = Totals(int(kinds), int(tokens), _discount(few.get(COUNTED, 0), few.get(DISHES, 0)), _discount(one, two), kinds_of_pairs, kinds)

        dishes = counted.where(F.col("kind") == DISHES).select("block", "data")
        known, kept = state.select("shard", "block", "keys", "data"), []
        for turn in range(burn + sweeps):
            asked = dishes.mapInArrow(_dish_sums(bits), _ROW).select("shard", "block", "keys", "data")
            told_back = at_shard(known.unionByName(asked), "block").mapInArrow(_parents(totals, turn), answer)
            both = told_back.unionByName(dishes.select(F.lit(DISHES).alias("kind"), whole, "block", "data"))
            made = scratch.store(at_block(both).mapInArrow(_reseat(totals, turn, turn > burn), "block long, data binary, sums array<double>"), f"dishes-{turn}")
            if turn:
                scratch.drop(f"dishes-{turn - 1}")
            more, tables = _sum(made, 2)
            totals = Totals(totals.kinds, totals.tokens, totals.child, totals.parent, kinds_of_pairs + more, tables)
            dishes = made.where("block >= 0").select("block", "data")
            if turn >= burn:
                kept.append(totals)

        summed = dishes.mapInArrow(_dish_sums(bits, sweeps), _ROW).select("shard", "block", "keys", "data")
        means = at_shard(known.unionByName(summed), "block").mapInArrow(_means(kept, burn + sweeps), "shard int, block long, keys binary, data binary, sums array<double>")
        means = scratch.store(means, "words")
        # The parent's tables of the kept sweeps, as they were seated just now.
        base = float(np.mean([Totals(t.kinds, t.tokens, t.child, t.parent, t.customers, n).base for t, n in zip(kept, _sum(means, sweeps), strict=True)]))
        words = at_shard(means.select("shard", "block", "keys", "data").unionByName(told.select("shard", "block", "keys", F.lit(None).cast("binary").alias("data"))), "block")
        tables = dishes.mapInArrow(_dish_tables(bits, sweeps), _ROW).select("shard", "block", "keys", "data")
        plural = at_shard(tables.unionByName(counted.where(F.col("kind") == PAIRS).select("shard", "block", "keys", "data")), "block")
        counts = counted.where(F.col("kind") == COUNTED).select("kind", F.lit(0).alias("shard"), "block", "data")
        told_back = scratch.store(words.mapInArrow(_answers(WORDS), answer).unionByName(plural.mapInArrow(_answers(PAIRS), answer)), "answers")
        for done in ("state", "words", f"dishes-{burn + sweeps - 1}"):
            scratch.drop(done)
        every = told_back.unionByName(counts).unionByName(full)
        schema = "doc long, n_tokens long, n_known long, base_score double, score double" + (", token_scores array<double>" if each else "")
        out = scratch.keep(at_block(every).mapInArrow(_scores(totals, base, sweeps, each), schema), "scores")
    return out.select(F.col("doc").alias(id_col), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score", *["token_scores"] * each)


def _sum(df: DataFrame, n: int) -> list[float]:
    """The sums of an array column of n numbers."""
    row = df.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(n)]).first()
    return [float(x) for x in row]


def perplexity(scored: DataFrame) -> Column:
    """Per token, over the rows that it is aggregated on."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))
