"""Near duplicates by word n-gram Jaccard similarity, through a MinHash LSH forest.

Documents with the same set of shingles are one node. Each node has a path of minima in each tree of the forest, and is
in a bucket per tree: that of the nodes whose paths begin alike, down to the prefix length at which the forest finds a
pair at the threshold with the target recall. All pairs of a bucket are candidates, those of crowded buckets block by
block, and each candidate is verified on its whole shingle sets. Classes are the connected components of the verified
links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sealed

TREES, DEPTH = 16, 8
RECALL = 0.998
#: Nodes of a bucket whose pairs are listed; a bucket of more is crowded, and compared by blocks.
FEW = 6
#: Nodes of a crowded bucket that a task compares with as many others.
SQUARE = 512
#: Word hashes that a worker remembers.
MEMO = 500_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


def shortest_prefix(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that pairs at the threshold share in some tree with the target recall."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - threshold**k) ** trees >= recall), 1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's n-word shingles, A-Z in lower case; a shorter text is one shingle."""
    from xxhash import xxh3_64_intdigest as digest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    get = _words.get
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = get(w)
        if v is None:
            v = _words[w] = digest(w)
        h[i] = v
    n = min(n, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        s = (s ^ (s >> np.uint64(29))) * _M[0] + h[i : i + len(s)] * _M[1]
    s ^= s >> np.uint64(32)
    return np.unique(s * _M[2])


def minima(s: np.ndarray) -> np.ndarray:
    """The signature, as big-endian 32-bit integers: their bytes sort as they do."""
    best = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(best, (s[i : i + 1024, None] * _A).min(0), out=best)
    return (best >> np.uint64(32)).astype(">u4")


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sizes, digs, sigs = [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), n)
                sizes.append(len(s))
                digs.append(xxh3_128_digest(s.tobytes()))
                sigs.append(minima(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc"), pa.array(sizes, pa.int32()), pa.array(digs, pa.binary()), pa.array(sigs, pa.binary())], names=["key", "doc", "n", "dig", "sig"])

    return run


def _paths(k: int):
    """From nodes to their places in the trees: tree, bucket (of the tree and the first k minima), node, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            keys, width = [], DEPTH * 4
            for s in b.column("sig").to_pylist():
                for t in range(TREES):
                    keys.append(xxh3_64_intdigest(s[t * width : t * width + 4 * k], seed=t) - 2**63)
            rep = lambda c: pa.array(np.repeat(np.array(c), TREES))
            yield pa.RecordBatch.from_arrays([pa.array(list(range(TREES)) * b.num_rows, pa.int32()), pa.array(keys, pa.int64()), rep(b.column("node")), rep(b.column("n"))], names=["tree", "bucket", "node", "n"])

    return run


def _candidates(threshold: float):
    """From sorted places to the pairs (a < b) of each bucket, of which a task holds one at a time: they are of FEW nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found = None, [], []

        def batch():
            a, b = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            for key, node, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "node", "n")), strict=True):
                if key != last:
                    last, held = key, []
                found += [(min(node, x), max(node, x)) for x, m in held if x != node and min(n, m) >= threshold * max(n, m)]
                held.append((node, n))
            yield batch()

    return run


def _compare(n: int, threshold: float):
    """From rows (a, b, side, text), sorted, to the pairs whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, left, known, kept = None, None, None, None
        for rows in batches:
            one, two = [], []
            for a, b, side, text in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "side", "text")), strict=True):
                if side == 0:
                    if known != a or pair != (a, b):
                        left = kept if known == a else shingles(text or b"", n)
                        known, kept = a, left
                        pair = (a, b)
                elif pair == (a, b):
                    right = shingles(text or b"", n)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if both >= threshold * (len(left) + len(right) - both) - 1e-9:
                        one.append(a)
                        two.append(b)
                        pair = None
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    return run


def verify(texts: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts (doc, text) are similar, on whole texts. A doc's text is sent once for each of its pairs."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), "a", "b", F.lit(0).alias("side")), F.struct(F.col("b").alias("doc"), "a", "b", F.lit(1).alias("side")))).alias("x")).select("x.*")
    # Both sides grow with the corpus: the join is shuffled at every size.
    rows = texts.join(sides.hint("merge"), "doc").select("a", "b", "side", "text")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(_compare(n, threshold), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the connected components of links (a, b), of the nodes that have a link; the label is one of its nodes.

    Each round points every node to its neighbour of least hash, or itself, merges along the pointers and keeps the
    links between different nodes. The hash differs by round, so chains shrink by a share of their length each time.
    """
    with Scratch(links.sparkSession, "components") as scratch:
        edges, turn = scratch.store(links.select("a", "b").where("a != b").distinct(), "links"), 0
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
        while not edges.isEmpty():
            mark = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), c.alias("to"))
            both = edges.select(F.col("a").alias("node"), mark(F.col("b")).alias("m")).union(edges.select(F.col("b").alias("node"), mark(F.col("a")).alias("m")))
            point = both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("m", mark(F.col("node")))["to"].alias("to"))
            point = scratch.store(point, f"pointers-{turn}")
            hop = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = scratch.store(point.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"hops-{turn}")
            if turn:
                moved = point.select(F.col("node").alias("label"), "to")
                labels = scratch.store(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"labels-{turn}")
            else:
                labels = point.select("node", F.col("to").alias("label"))
            pa_, pb_ = point.select(F.col("node").alias("a"), F.col("to").alias("x")), point.select(F.col("node").alias("b"), F.col("to").alias("y"))
            merged = edges.join(pa_, "a").join(pb_, "b").where("x != y")
            edges = scratch.store(merged.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links-{turn}")
            turn += 1
        return scratch.keep(labels, "labels")


def classes(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, n_links), one row per row of docs.

    class_id: the least id of the documents that verified links join, directly or not; a document without any has its
    own. n_links: the other documents whose set of shingles is the same, and those of its verified links. All pairs of
    a bucket are compared. The links of crowded buckets are counted where they are found, so their number, which grows
    with the square of a group, makes no rows.

    Words go by white space. A null text is empty; texts without words have the same empty set, and are one class. Rows
    that share an id are in one class, whatever their texts, and each counts the links of its own text. Rows with a null
    id have null class_id and 0 links. An empty table gives none.
    """
    s = Sealed(docs, id_col, text_col)
    text = F.coalesce(s[text_col], F.lit("")).cast("binary")
    given = s.df.select(s[id_col].cast("long").alias("doc"), text.alias("text"))
    texts = given.where("doc IS NOT NULL").withColumn("key", F.xxhash64("doc", "text"))
    k = shortest_prefix(threshold)
    with Scratch(docs.sparkSession, "near") as scratch:
        signed = scratch.store(texts.mapInArrow(_sign(words), "key long, doc long, n int, dig binary, sig binary"), "signatures")
        # A node is a shingle set, under the key of a row that has it.
        made = signed.groupBy("dig").agg(F.min(F.struct("doc", "key")).alias("of"), F.count_distinct("doc").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"))
        sets = scratch.store(made.select("dig", F.col("of.key").alias("node"), F.col("of.doc").alias("doc"), "copies", "n", "sig"), "sets")
        forest = scratch.store(sets.where("n > 0").mapInArrow(_paths(k), "tree int, bucket long, node long, n int"), "forest")
        sizes = forest.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        # A bucket may be of any size: this is a join that Spark may split, and nothing holds a bucket but the small ones.
        places = scratch.store(forest.join(sizes, "bucket"), "places")
        scratch.drop("forest")
        few = places.where(F.col("size") <= FEW).repartition("bucket").sortWithinPartitions("bucket", "node")
        pairs = scratch.store(few.mapInArrow(_candidates(threshold), "a long, b long").distinct(), "pairs")
        whole = texts.select(F.col("key").alias("doc"), "text")
        links = scratch.store(verify(whole, pairs, words, threshold), "links").distinct()
        count = sets.select("node", "copies")
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x")).select("x.*")
        linked = ends.join(count.withColumnRenamed("node", "to"), "to").select("node", F.col("copies").alias("linked"))

        crowd = places.where(F.col("size") > FEW)
        if not crowd.isEmpty():
            more = scratch.store(_crowded(whole, sets, crowd, words, threshold, k), "crowded-links")
            links = links.union(more.where("b IS NOT NULL").select("a", "b"))
            linked = linked.union(more.where("linked IS NOT NULL").select("a", "linked"))
        # Different texts of one document are one class.
        owned = signed.select("doc", "dig").join(sets.select("dig", "node"), "dig").select("doc", "node")
        several = owned.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").select("doc", "a")
        links = links.union(owned.join(several, "doc").select("a", F.col("node").alias("b")))
        labels = components(links)
        linked = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
        least = labels.join(sets.select("node", "doc"), "node").groupBy("label").agg(F.min("doc").alias("class_id"))
        named = labels.join(least, "label").select("node", "class_id")
        known = sets.select("dig", "node", "doc", "copies").join(named, "node", "left").join(linked, "node", "left")
        known = known.select("dig", F.coalesce("class_id", "doc").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        out = signed.select("doc", "dig").join(known, "dig").select(F.col("doc").alias(id_col), "class_id", "n_links")
        unnamed = given.where("doc IS NULL").select(F.col("doc").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        return scratch.keep(out.unionByName(unnamed), "classes")


def _crowded(texts: DataFrame, sets: DataFrame, places: DataFrame, n: int, threshold: float, k: int) -> DataFrame:
    """The links in the given buckets, as sums of copies by node (a, linked) and as those (a, b) that connect a unit's nodes.

    A bucket's nodes are dealt into blocks of about SQUARE, and each pair of blocks is a unit of work: a node is sent to
    as many units as the bucket has blocks.
    """
    blocks = F.ceil(F.col("size") / SQUARE).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    units = places.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    units = units.select("tree", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "mine")
    nodes = places.groupBy("node").agg(F.bit_or(F.expr("1 << tree")).alias("trees")).hint("merge")  # grows with the corpus
    with_text = texts.join(nodes, texts["doc"] == nodes["node"], "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
    known = sets.select("node", "sig", "copies").join(nodes, "node").join(with_text.withColumnRenamed("doc", "node"), "node")
    rows = units.join(known, "node").select("bucket", "i", "j", "tree", "mine", "node", "copies", "trees", "sig", "text")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "mine", "node").mapInArrow(_square(n, threshold, k), "a long, b long, linked long")


def _square(n: int, threshold: float, k: int):
    """From the sorted rows of units to the links of the pairs whose first common bucket this is, if no bucket that is
    compared pair by pair has them."""

    def links(tree: int, apart: bool, rows: list[tuple]) -> Iterator[tuple[int, int | None, int | None]]:
        side, node, copies, trees, sig, sets = zip(*rows, strict=True)
        side, copies, node = np.array(side), np.array(copies), np.array(node)
        size = np.array([len(s) for s in sets])
        first = np.r_[0, np.cumsum(size)]
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
        sigs = np.stack([np.frombuffer(x, ">u4") for x in sig]).astype(np.uint32).reshape(len(rows), TREES, DEPTH)[:, :, :k]
        buckets = np.stack([np.unique(sigs[:, t], axis=0, return_inverse=True)[1].reshape(-1) for t in range(TREES)], 1)
        # The trees in which a common bucket means that the pair is compared there.
        t = np.arange(TREES)
        elsewhere = (t < tree) | (np.array(trees)[:, None] >> t & 1 == 0)
        mark, group, linked = np.zeros(ids.max() + 1, np.uint8), np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for x in range(len(rows) - 1):
            y = np.arange(x + 1, len(rows))
            ok = np.minimum(size[y], size[x]) >= threshold * np.maximum(size[y], size[x])
            if apart:
                ok &= side[y] != side[x]
            ok &= ~((buckets[y] == buckets[x]) & elsewhere[x]).any(1)
            y = y[ok & (node[y] != node[x])]
            if not len(y):
                continue
            starts = np.r_[0, np.cumsum(size[y])]
            at = np.arange(starts[-1]) + np.repeat(first[y] - starts[:-1], size[y])
            mark[ids[first[x] : first[x + 1]]] = 1
            both = np.add.reduceat(mark[ids[at]], starts[:-1], dtype=np.int64)
            mark[ids[first[x] : first[x + 1]]] = 0
            y = y[both >= threshold * (size[x] + size[y] - both) - 1e-9]
            linked[x] += copies[y].sum()
            linked[y] += copies[x]
            for g, z in zip(*np.unique(group[y], return_index=True), strict=True):
                if g != group[x]:
                    group[group == g] = group[x]
                    a, b = int(node[x]), int(node[y[z]])
                    yield min(a, b), max(a, b), None
        for x in np.flatnonzero(linked):
            yield int(node[x]), None, int(linked[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("bucket", "i", "j", "tree", "mine", "node", "copies", "trees", "sig", "text")]
            for bucket, i, j, tree, *row, text in zip(*cols, strict=True):
                if (bucket, i, j, tree) != key:
                    if rows:
                        found += links(key[3], key[1] != key[2], rows)
                    key, rows = (bucket, i, j, tree), []
                rows.append((*row, shingles(text or b"", n)))
        if rows:
            found += links(key[3], key[1] != key[2], rows)
        a, two, linked = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(two, pa.int64()), "linked": pa.array(linked, pa.int64())})

    return run


def keep_one(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose class has a document of smaller id; rows with a null id stay."""
    s = Sealed(docs, id_col, text_col)
    gone = classes(docs, threshold, words, id_col, text_col).where(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    return s.replace(s.df.join(gone, s[id_col] == F.col("gone"), "left_anti"))
