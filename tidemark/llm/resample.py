"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Each bucket of features has a gain, its log ratio of shares in target and corpus; a document's weight is its mean gain, and
Gumbel noise on top makes the highest scores a draw without replacement. The drawn documents are ranked by merging: each
partition writes its eligible rows as a sorted run, cut into slices at scores whose places are known from exact counts,
and one task for each range of scores merges the runs' slices in a tournament tree. Ranges beyond the draw aren't merged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sealed

BUCKETS = 10000
#: Rows that a range has at least, and ranges at most (a range grows only where these would be more).
RANGE_ROWS, RANGES = 4096, 4096
#: Text bytes and words that are handled at a time, and different words that a task remembers.
PIECE, STEP, MEMORY = 1 << 22, 1 << 20, 1 << 18

#: A-Z to a-z; what is no letter, digit or part of a character beyond ASCII is a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def _zeros() -> np.ndarray:
    """By number of bytes, place and value: what a byte of a CRC-32 becomes when so many zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    c = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    out = [c]
    for _ in range(_LONG + 1):
        c = (c >> 8) ^ table[c & 255]
        out.append(c)
    return np.stack(out)


class _Words(dict):
    """Numbers of words, with what is needed to hash a word, and a word after another one."""

    def __init__(self):
        self.crc, self.after, self.size, self.text = [], [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.crc.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        self.text.append(word)
        return n


class Hasher:
    """Buckets of the features of texts: all words, and all pairs of consecutive words."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.words, self.zeros = buckets, _Words(), _zeros()

    def ids(self, text: bytes) -> np.ndarray:
        if len(self.words) > MEMORY:
            self.words = _Words()
        plain, parts, at = text.translate(_WORDS), [], 0
        while at < len(plain):
            end = plain.find(b" ", at + PIECE)
            end = len(plain) if end < 0 else end
            parts.append(np.array(list(map(self.words.__getitem__, plain[at:end].split())), np.int64))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def buckets_of(self, ids: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of the words, buckets of the pairs that begin at the words where joined)."""
        w = self.words
        crc, after, size = np.array(w.crc, np.uint32), np.array(w.after, np.uint32), np.array(w.size, np.int64)
        a, b = ids[:-1][joined], ids[1:][joined]
        c, k = crc[a], np.minimum(size[b], _LONG + 1)
        pair = after[b]
        for place in range(4):
            pair = pair ^ self.zeros[k, place, (c >> np.uint32(8 * place)) & np.uint32(255)]
        for i in np.flatnonzero(size[b] > _LONG + 1):
            pair[i] = zlib.crc32(b" " + w.text[b[i]], w.crc[a[i]])
        return crc[ids] % self.buckets, pair % self.buckets

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """Blocks of features of consecutive texts: their buckets, and (number of the text, features) in order. A long text comes in several blocks."""
        held, n = [], 0
        for i, t in enumerate(texts):
            ids = self.ids(t)
            for at in range(0, max(1, len(ids)), STEP):
                part = ids[max(0, at - 1) : at + STEP]  # with the word before, for the pair across the cut
                held.append((i, part, at > 0))
                n += len(part)
                if n >= STEP:
                    yield self._block(held)
                    held, n = [], 0
            if held and (len(self.words) > MEMORY or i + 1 == len(texts)):
                yield self._block(held)
                held, n = [], 0

    def _block(self, held):
        ids = np.concatenate([p for _, p, _ in held])
        joined = np.ones(max(0, len(ids) - 1), bool)
        ends = np.cumsum([len(p) for _, p, _ in held])
        joined[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(ids))] - 1] = False
        one, two = self.buckets_of(ids, joined)
        # The features of a text side by side: its words, then its pairs.
        start, sizes, order = 0, [], []
        places = np.concatenate([[0], np.cumsum(joined)])
        for (i, p, cut), end in zip(held, ends, strict=True):
            end = int(end)
            first = start + cut
            pairs = two[places[start] : places[end - 1]] if end > start else two[:0]
            order += [one[first:end], pairs]
            sizes.append((i, end - first + len(pairs)))
            start = end
        return np.concatenate(order), sizes


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of the whole texts fall in each bucket; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for found, _ in hasher.of(_texts(b.column(0))):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    counts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """For each bucket floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), from bucket_counts()."""
    s, t = ({r["bucket"]: r["n"] for r in c.collect()} for c in (corpus, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((float(t.get(i, 0) + 1) * all_s) / (float(s.get(i, 0) + 1) * all_t))) for i in range(buckets)]


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise of an id, times 1000; a null id counts as the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: list[int], seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row. A text without features has weight 0."""
    values = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(values))
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for found, sizes in hasher.of(_texts(b.column(1))):
                at = np.concatenate([[0], np.cumsum(values[found])])
                end = 0
                for i, k in sizes:
                    n[i] += k
                    total[i] += at[end + k] - at[end]
                    end += k
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = b.column(0)
            noisy = weight + np.array([noise(seed, i) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in ((n + 1) // 2, n, weight, noisy)]], names=["id", "n_words", "n_features", "weight", "score"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def _ranges(counts: list[tuple[int, int]], draw: int) -> tuple[list[int], int]:
    """(the highest score of each range, the least score of all) from (score, rows) by falling score, as far as the draw goes."""
    room = max(RANGE_ROWS, -(-draw // RANGES))
    highest, size, seen, least = [], room, 0, None
    for value, n in counts:
        if seen >= draw:
            break
        if size + n > room:
            highest.append(value)
            size = 0
        size, seen, least = size + n, seen + n, value
    return highest, least


class Tournament:
    """A tree of losers over sorted lists: next() is the number of the list with the least head. Ties go to the lower number."""

    def __init__(self, lists: list[list]):
        self.lists, self.k = lists, max(1, len(lists))
        self.at = [0] * self.k
        self.head = [(0, x[0], i) if x else (1, 0, i) for i, x in enumerate(lists)] or [(1, 0, 0)]
        self.loser = [0] * self.k
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        """The winner below a node; nodes k to 2k - 1 are the lists."""
        order, won = [1], {}
        for n in order:  # all nodes above the lists, from the root
            if n < self.k:
                order += [2 * n, 2 * n + 1]
        for n in reversed(order):
            if n >= self.k:
                won[n] = n - self.k
                continue
            a, b = won[2 * n], won[2 * n + 1]
            won[n], self.loser[n] = (a, b) if self.head[a] <= self.head[b] else (b, a)
        return won[node]

    def next(self) -> int | None:
        w = self.winner
        if self.head[w][0]:
            return None
        self.at[w] += 1
        items = self.lists[w]
        self.head[w] = (0, items[self.at[w]], w) if self.at[w] < len(items) else (1, 0, w)
        out, node = w, (w + self.k) // 2
        while node:
            if self.head[self.loser[node]] < self.head[w]:
                w, self.loser[node] = self.loser[node], w
            node //= 2
        self.winner = w
        return out


_SLICE = "range long, run long, id array<long>, n_features array<long>, weight array<long>, score array<long>"
_COLUMNS = ("id", "n_features", "weight", "score")


def _slices(highest: list[int], hot: dict[int, list[int]]):
    """Rows sorted by falling score and id, packed as one row for each range. hot: ids that part the rows of one score."""
    tops = -np.array(highest, np.int64)
    width = 1 + max([0, *map(len, hot.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            scores = b.column("score").to_numpy()
            place = (np.searchsorted(tops, -scores, side="right") - 1) * width
            ids = b.column("id").fill_null(np.iinfo(np.int64).max).to_numpy() if hot else None
            for value, cuts in hot.items():
                here = scores == value
                place[here] += np.searchsorted(np.array(cuts), ids[here], side="left")
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), b.num_rows]
            offsets = pa.array(edges, pa.int32())
            packed = [pa.ListArray.from_arrays(offsets, b.column(c)) for c in _COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(place[edges[:-1]]), pa.array([me] * (len(edges) - 1), pa.int64()), *packed], names=["range", "run", *_COLUMNS])

    return run


def _merge(before: dict[int, int], draw: int):
    """The rows of a range's slices with their ranks; from the draw's end on without one."""

    def run(table: pa.Table) -> pa.Table:
        first = before[table.column("range")[0].as_py()]
        lists = {c: table.column(c).to_pylist() for c in _COLUMNS}
        none = np.iinfo(np.int64).max
        keys = [[(-s, i is None, none if i is None else i) for s, i in zip(a, b, strict=True)] for a, b in zip(lists["score"], lists["id"], strict=True)]
        tree, taken, left = Tournament(keys), [], max(0, draw - first)
        while len(taken) < left and (w := tree.next()) is not None:
            taken.append((w, tree.at[w] - 1))
        rest = [(w, j) for w, x in enumerate(keys) for j in range(tree.at[w], len(x))]
        ranks = [*range(first + 1, first + 1 + len(taken)), *[None] * len(rest)]
        cols = [pa.array([lists[c][w][j] for w, j in [*taken, *rest]], pa.int64()) for c in _COLUMNS]
        return pa.Table.from_arrays([*cols, pa.array(ranks, pa.int64())], names=[*_COLUMNS, "rank"])

    return run


def rank(scored: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of score(), whose ids are whole numbers.

    Of the N rows of at least min_words words the floor(percent * N / 100) of highest score have ranks 1, 2, 3, ...; ties go
    to the smaller id, null last. Other rows have none. What comes to the driver is a count for each score (scores lie
    within about 100 000 values, whatever the input) and for each range. Many rows of one score are parted by id.
    """
    with Scratch(scored.sparkSession, "resample") as scratch:
        scored = scratch.store(scored.withColumn("id", F.col("id").cast("long")), "scored")
        able = scored.where(F.col("n_words") >= min_words)
        counts = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
        draw = percent * sum(n for _, n in counts) // 100
        unranked = F.lit(None).cast("long").alias("rank")
        if not draw:
            return scratch.keep(scored.select(*_COLUMNS, unranked), "ranked")
        highest, least = _ranges(counts, draw)
        room = max(RANGE_ROWS, -(-draw // RANGES))
        hot = {s: -(-n // room) for s, n in counts if n > 2 * room and s >= least}
        if hot:
            parts = max(hot.values())
            cuts = able.where(F.col("score").isin(list(hot))).groupBy("score").agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"))
            hot = {r["score"]: sorted(set(r["cuts"] or [])) for r in cuts.collect()}
        top = able.where(F.col("score") >= least).select(*_COLUMNS).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id"))
        runs = scratch.store(top.mapInArrow(_slices(highest, hot), _SLICE), "runs")
        sizes = sorted((r["range"], r["n"]) for r in runs.groupBy("range").agg(F.sum(F.size("id")).alias("n")).collect())
        before, total = {}, 0
        for k, n in sizes:
            before[k], total = total, total + n
        last = max(k for k, b in before.items() if b < draw)
        merged = runs.where(F.col("range") <= last).groupBy("range").applyInArrow(_merge(before, draw), "id long, n_features long, weight long, score long, rank long")
        beyond = runs.where(F.col("range") > last).select(F.explode(F.arrays_zip(*_COLUMNS)).alias("r")).select("r.*", unranked)
        rest = scored.where((F.col("n_words") < min_words) | (F.col("score") < least)).select(*_COLUMNS, unranked)
        return scratch.keep(merged.unionByName(beyond).unionByName(rest), "ranked")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id under its own name, n_features, weight, score, rank) of each row of docs: see score() and rank().

    Null and empty texts have no words; an empty table gives an empty one; an empty target has its smoothing only. Rows
    that share an id are rows of their own with the same noise. Other columns play no part: drawn() gives the documents.
    """
    s = Sealed(docs, id_col, text_col)
    gain = gains(bucket_counts(s.df, s.inner[text_col], buckets), bucket_counts(target, text_col, buckets), buckets)
    ranked = rank(score(s.df, gain, seed, s.inner[id_col], s.inner[text_col]), percent, min_words)
    return ranked.withColumnRenamed("id", id_col)


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id was drawn, with the columns of docs."""
    ids = ranked.where("rank IS NOT NULL").select(F.col(id_col).alias("drawn__")).distinct()
    return docs.join(ids, docs[id_col] == ids["drawn__"], "left_semi")

