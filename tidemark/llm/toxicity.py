"""Toxicity by weak supervision.

Many lexicon and pattern voters vote on every document. A generative label model estimates, by expectation maximisation
over all documents, how often each votes on either class and which voters hang together: within a class the votes form a
tree, in which a voter's rate depends on the vote of the one above it. A linear classifier is then trained on the model's
posterior labels, and scores texts from their words alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType

from .common import Scratch, Sealed

#: Common insults, each a lexicon voter's entry.
INSULTS = (
    "arse bastard bitch clown coward creep crap disgusting dumb dumbass filth fool freak garbage idiot ignorant imbecile "
    "jerk liar loser maggot moron pathetic pig retard rotten scum shit shut slut stupid trash twat ugly useless vermin whore worthless"
).split()
#: The same of other languages, a voter for each language.
OTHER_INSULTS = {
    "de": "arsch arschloch depp dreck dummkopf fotze hure hurensohn idiotin schlampe schwachkopf schwein scheisse scheiße trottel wichser".split(),
    "es": "asqueroso basura cabron cabrón estupido estúpido gilipollas idiota imbecil imbécil inutil inútil mierda payaso perra puta zorra".split(),
    "fr": "abruti batard bâtard conard connard connasse cretin crétin debile débile encule enculé merde ordure pute salaud salope".split(),
}
#: Rows of each class that the classifier is trained on, at most.
SAMPLE = 6_000
#: A posterior beyond which, or beyond whose complement, a document may train the classifier.
SURE = 0.9
#: Voters with learned lexicons; words of all of them, and features that the classifier has, at most.
LEXICONS, LEXICON_WORDS, FEATURES = 24, 1_536, 8_192
#: Labels that are broadcast to the texts, at most, if their ids are numbers; beyond that the texts are shuffled to them.
NEAR = 2_000_000
#: Characters of a word that is its own feature, at most; and what stands for a row as such among the features.
LONGEST, EVERY = 64, ""

#: A voter's name, what a text that it finds must have (quick to look for), and what it looks for.
PATTERNS = (
    ("exclaims", re.compile(r"!"), re.compile(r"!{2,}")),
    ("masked", re.compile(r"[*@#$]{2}"), re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*\b", re.I)),
    ("shouts", re.compile(r"[A-Z]{4}\b"), re.compile(r"(?:\b[A-Z]{4,}\b\W+){3}")),
    ("accuses", re.compile(r"[uU]"), re.compile(r"\b(?:your?|ur?)(?:'?re| are| is)? (?:\w+ )?(?:" + "|".join(INSULTS) + r")\b", re.I)),
)
SPLIT = 3  # voters that the first list is dealt to
FIXED = SPLIT + len(OTHER_INSULTS)
VOTERS = FIXED + LEXICONS + len(PATTERNS)
#: A row's three sets of votes: of the whole lexicon, and as it would be without the row itself, if clean or if toxic.
VIEWS = ("votes_any", "votes_clean", "votes_toxic")
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_…«»¿¡"


def features(text: str) -> set[str]:
    """A text's lower-case words without punctuation at their edges, and first four and five letters, which end in a space.

    Words of more than 64 characters are known by their first letters and a hash.
    """
    words = {w.strip(_EDGES) for w in set(text.lower().split())}
    found = {w if len(w) <= LONGEST else _short(w) for w in words if len(w) > 1}
    found.update([w[:4] + " " for w in words if len(w) > 4])
    found.update([w[:5] + " " for w in words if len(w) > 5])
    return found


def _short(word: str) -> str:
    return word[:LONGEST] + hashlib.sha256(word.encode("utf-8", "replace")).hexdigest()


def fixed_words() -> dict[str, tuple[int, int]]:
    """Insult -> one of the FIXED voters, in every view."""
    every = (1 << len(VIEWS)) - 1
    lists = [(i % SPLIT, w) for i, w in enumerate(INSULTS)] + [(SPLIT + i, w) for i, ws in enumerate(OTHER_INSULTS.values()) for w in ws]
    return {w: (voter, every) for voter, w in reversed(lists)}


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fs, p = [sorted(features(t or "")) for t in b.column("text").to_pylist()], b.column("p").to_numpy(zero_copy_only=False)
        flat = pa.chunked_array([pa.array(f, pa.string()) for f in (*fs, [EVERY] * len(fs))], pa.string()).combine_chunks().dictionary_encode()
        share, at = np.r_[np.repeat(p, [len(f) for f in fs]), p], flat.indices.to_numpy(zero_copy_only=False)
        n = len(flat.dictionary)
        toxic, clean = np.bincount(at, share, n), np.bincount(at, 1 - share, n)
        yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(toxic), pa.array(clean)], names=["f", "toxic", "clean"])


def counted(rows: DataFrame) -> DataFrame:
    """(f, toxic, clean): rows (text, p) with a feature, by class, p being the share that is toxic. Feature EVERY is every row's."""
    made = rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("p").cast("double").alias("p")).mapInArrow(_counting, "f string, toxic double, clean double")
    return made.groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _totals(counts: DataFrame) -> tuple[float, float]:
    r = counts.where(F.col("f") == EVERY).first()
    return (r["toxic"], r["clean"]) if r else (0.0, 0.0)


def mine(counts: DataFrame, least: float = 24) -> dict[str, tuple[int, int]]:
    """Feature -> its learned lexicon voter and the views in which it is in the lexicon.

    A lexicon has the features that toxic rows have ten times as often as others, with a log likelihood ratio of least so
    that few of a large vocabulary are there by chance; the LEXICON_WORDS with the largest. A row's own label must not speak
    for it twice, so a feature counts in a labelled row's votes only if it would be in the lexicon without that row.
    """
    n1, n0 = _totals(counts)
    if n1 < 2 or n0 < 2:
        return {}

    def strong(own1: int, own0: int) -> tuple[Column, Column]:
        a, b = F.col("toxic") - own1, F.greatest(F.col("clean") - own0, F.lit(0.0))
        m1, m0 = n1 - own1, n0 - own0
        ratio = ((a + 0.1) / (m1 + 1)) / ((b + 0.5) / (m0 + 1))
        likelier = lambda x, m: F.when(x > 0, x * F.log(x * (m1 + m0) / ((a + b) * m))).otherwise(0.0)
        g = 2 * (likelier(a, m1) + likelier(b, m0))
        return (ratio > 10) & (g > least), g

    views = [strong(0, 0), strong(0, 1), strong(1, 0)]
    best = counts.where(F.col("f") != EVERY).where(views[1][0]).orderBy(F.desc(views[1][1]), "f").limit(LEXICON_WORDS)
    rows = best.select("f", *[v[0].alias(n) for n, v in zip(VIEWS, views, strict=True)]).collect()
    return {r["f"]: (FIXED + crc32(r["f"].encode()) % LEXICONS, sum(bool(r[n]) << i for i, n in enumerate(VIEWS))) for r in rows}


def _feature_votes(lexicon: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Feature -> its vote as bits, VOTERS of them for each view."""
    return {f: sum((views >> i & 1) << (i * VOTERS + voter) for i in range(len(VIEWS))) for f, (voter, views) in lexicon.items()}


def votes(text: str, lexicon: dict[str, int]) -> tuple[int, ...]:
    """The votes on a text in each view, voter 0 the lowest bit."""
    bits, found = 0, 0
    for f in lexicon.keys() & features(text):
        bits |= lexicon[f]
    for i, (_, hint, p) in enumerate(PATTERNS):
        found |= (hint.search(text) is not None and p.search(text) is not None) << (FIXED + LEXICONS + i)
    return tuple(bits >> (i * VOTERS) & ((1 << VOTERS) - 1) | found for i in range(len(VIEWS)))


def _packed(bits: list[int]) -> pa.Array:
    v = (np.array(bits, np.int64)[:, None] >> np.arange(VOTERS)) & 1
    return pa.array([x.tobytes() for x in np.packbits(v.astype(bool), axis=1)], pa.binary())


def _matrix(col: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1), axis=1)[:, :VOTERS].astype(float)


@dataclass
class LabelModel:
    """Share of toxic documents, each voter's rate by class, and a tree of voters with the rates that it gives them."""

    prior: float
    rates: np.ndarray  # 2 by VOTERS
    parent: np.ndarray  # -1: none
    given: np.ndarray  # 2 by VOTERS by the vote of the voter above

    def posterior(self, v: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, v[:, self.parent], 0).astype(int)
        r = np.clip(self.given[:, np.arange(VOTERS), above], 1e-5, 1 - 1e-5)
        z = math.log(self.prior / (1 - self.prior)) + np.where(v > 0, np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(information: np.ndarray) -> np.ndarray:
    """Parents in the tree with the most information; a voter that says less than 1e-4 about the rest has none."""
    parent, best, open_ = np.full(VOTERS, -1), np.full(VOTERS, 1e-4), np.ones(VOTERS, bool)
    at = 0
    for _ in range(VOTERS):
        open_[at] = False
        closer = open_ & (information[at] > best)
        parent[closer], best[closer] = at, information[at][closer]
        at = int(np.argmax(np.where(open_, best, -1)))
    return parent


def _estimate(t: np.ndarray) -> LabelModel:
    """The model of the expected counts t: by class, of rows, votes and pairs of votes."""
    n, one, two = t[:, 0], t[:, 1 : 1 + VOTERS], t[:, 1 + VOTERS :].reshape(2, VOTERS, VOTERS)
    rates = (one + np.array([[0.01], [0.05]])) / (n + 1)[:, None]
    information = np.zeros((VOTERS, VOTERS))
    for c in range(2):
        n11 = two[c]
        n10, n01 = one[c][:, None] - n11, one[c][None, :] - n11
        n00 = n[c] - n11 - n10 - n01
        on, off = one[c] + 0.5, n[c] - one[c] + 0.5
        for joint, a, b in ((n11, on, on), (n10, on, off), (n01, off, on), (n00, off, off)):
            joint = np.maximum(joint, 0)
            information += joint * np.log((joint + 1e-9) * (n[c] + 1) / (a[:, None] * b[None, :]) + 1e-12) / (n.sum() + 1)
    np.fill_diagonal(information, 0)
    parent = _tree(information)
    given = np.repeat(rates[:, :, None], 2, 2)
    for i in np.flatnonzero(parent >= 0):
        j = parent[i]
        with_, without = two[:, i, j], one[:, i] - two[:, i, j]
        # Rare votes are drawn to the voter's own rate.
        given[:, i, 1] = (with_ + rates[:, i]) / (one[:, j] + 1)
        given[:, i, 0] = (without + rates[:, i]) / (n - one[:, j] + 1)
    return LabelModel(float(np.clip((n[1] + 1) / (n.sum() + 20), 1e-4, 0.9)), rates, parent, given)


def _sums(model: LabelModel):
    """Each task's sums over its kinds of rows: weight, votes and products of votes, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + VOTERS + VOTERS * VOTERS))
        for b in batches:
            if not b.num_rows:
                continue
            v, n = _matrix(b.column("votes")), b.column("n").to_numpy(zero_copy_only=False)
            p = model.posterior(v)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            p = np.where(np.isnan(y), p, y)
            for c, w in enumerate((n * (1 - p), n * p)):
                total[c] += np.r_[w.sum(), w @ v, ((v * w[:, None]).T @ v).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["x"])

    return run


def fit_labels(voted: DataFrame, steps: int = 20, still: float = 1e-3) -> LabelModel:
    """EM over all rows of voted (votes, y), y null where no label is known, until rates are still, or for that many steps.

    It starts at what the labelled rows say, or without those from the assumption that votes are mostly right. What each
    step brings back is of fixed size.
    """
    rates = np.vstack([np.full(VOTERS, 0.02), np.r_[np.full(FIXED + LEXICONS, 0.3), np.full(len(PATTERNS), 0.05)]])
    model = LabelModel(0.1, rates, np.full(VOTERS, -1), np.repeat(rates[:, :, None], 2, 2))

    def step(rows: DataFrame) -> LabelModel | None:
        made = rows.mapInArrow(_sums(model), "x array<double>").select(F.posexplode("x").alias("i", "x"))
        t = np.array([r["x"] for r in made.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]).reshape(2, -1)
        return _estimate(t) if t.size and t[:, 0].sum() > 0 else None

    with Scratch(voted.sparkSession, "labels") as scratch:
        # Rows that got the same votes are alike to the model.
        kinds = scratch.store(voted.groupBy("votes", "y").agg(F.count("*").alias("n")), "kinds")
        model = step(kinds.where("y IS NOT NULL")) or model
        for _ in range(steps):
            before, model = model, step(kinds) or model
            if max(np.abs(model.rates - before.rates).max(), abs(model.prior - before.prior)) < still:
                break
    return model


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self.weights.keys() & features(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def select(counts: DataFrame) -> list[str]:
    """The classifier's features: those whose rates differ most surely between the classes."""
    n1, n0 = (n + 1e-9 for n in _totals(counts))
    a, b = F.col("toxic"), F.col("clean")
    pool = (a + b + 1) / (n1 + n0 + 2)
    z = F.abs((a / n1 - b / n0) / F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0)))
    best = counts.where(F.col("f") != EVERY).where((a + b >= 3) & (z > 4)).orderBy(F.desc(z), "f").limit(FEATURES)
    return sorted(r["f"] for r in best.select("f").collect())


def train(chosen: list[str], x: list[np.ndarray], p: np.ndarray, weight: np.ndarray, steps: int = 2_000) -> Classifier:
    """Logistic regression on soft labels p; x has each row's places in the list of features."""
    share = float(np.clip((weight @ p + 0.1) / (weight.sum() + 1), 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    if not len(p):
        return Classifier({}, bias)
    k = len(chosen)
    rows, cols = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)
    w, g2 = np.zeros(k + 1), np.full(k + 1, 1e-8)
    w[-1] = bias
    for _ in range(steps):
        s = np.bincount(rows, w[cols], len(x)) + w[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - p) / weight.sum()
        g = np.r_[np.bincount(cols, e[rows], k), e.sum()] + np.r_[1e-6 * w[:-1], 0]
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return Classifier(dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def _featured(rows: DataFrame, chosen: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The chosen features of a bounded sample (text, p, weight), at the driver: at most FEATURES a row."""
    known = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [np.array(sorted(known[w] for w in known.keys() & features(t or "")), np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), b.column("p"), b.column("weight")], names=["f", "p", "weight"])

    t = rows.select("text", "p", "weight").mapInArrow(run, "f binary, p double, weight double").toArrow()
    return [np.frombuffer(f, np.int32) for f in t["f"].to_pylist()], t["p"].to_numpy(), t["weight"].to_numpy()


def _voting(lexicon: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _feature_votes(lexicon)
        for b in batches:
            v = [votes(t or "", words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *[_packed([x[i] for x in v]) for i in range(len(VIEWS))]], names=["id", "key", *VIEWS])

    return run


def _posteriors(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.posterior(_matrix(b.column("votes"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(p, pa.float64())], names=["key", "n", "p"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """A classifier, from the documents whose row satisfies learn (a condition on the id under the name 'id').

    Labels are used for those documents only: all of them give the learned lexicons and the label model's classes of
    their rows, beside the votes on all the other documents. The classifier is trained on the posterior labels of a
    bounded sample of each class (SAMPLE rows, by hash of id and text) that the model is SURE of, known labels aside. Of several labels of a document
    the largest holds; null labels and ids are left out. Rows that repeat an id and a text count as often as they come, but
    are one row of the sample; rows that share an id only are rows of their own, with its label. Without labels, the fixed
    lexicons and the patterns alone vote.
    """
    s = Sealed(docs, id_col, text_col)
    texts = s.df.select(s[id_col].alias("id"), s[text_col].alias("text")).where("id IS NOT NULL").where(learn)
    texts = texts.withColumn("key", F.xxhash64("id", "text"))
    id_type = texts.schema["id"].dataType.simpleString()
    known = labels.select(F.col(id_col).cast(id_type).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where(learn).groupBy("id").agg((F.max("y") > 0).cast("double").alias("y"))
    some = lambda d, cond: d.where(cond).orderBy("key").limit(SAMPLE)
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        known = scratch.store(known, "known")
        if isinstance(known.schema["id"].dataType, IntegralType) and known.count() <= NEAR:
            known = F.broadcast(known)
        lexicon = mine(scratch.store(counted(texts.join(known, "id").select("text", F.col("y").alias("p"))), "mined")) | fixed_words()
        made = texts.mapInArrow(_voting(lexicon), f"id {id_type}, key long, " + ", ".join(f"{v} binary" for v in VIEWS))
        own = F.when(F.col("y") == 1, F.col("votes_toxic")).when(F.col("y") == 0, F.col("votes_clean")).otherwise(F.col("votes_any"))
        voted = scratch.store(made.join(known, "id", "left").select("key", "y", own.alias("votes")), "votes")
        model = fit_labels(voted.select("votes", "y"))
        # Rows of one id and text got the same votes and label: they are one row that counts several times.
        rows = voted.groupBy("key").agg(F.count("*").alias("n"), F.first("votes").alias("votes"))
        post = scratch.store(rows.mapInArrow(_posteriors(model), "key long, n long, p double"), "posteriors")
        sure = post.where(~F.col("p").between(1 - SURE, SURE))
        sizes = {r["toxic"]: r["n"] for r in sure.groupBy((F.col("p") >= 0.5).alias("toxic")).agg(F.count("*").alias("n")).collect()}
        weight = F.when(F.col("p") >= 0.5, max(1.0, sizes.get(True, 0) / SAMPLE)).otherwise(max(1.0, sizes.get(False, 0) / SAMPLE))
        chosen = scratch.store(some(sure, "p >= 0.5").union(some(sure, "p < 0.5")).select("key", "p", (weight * F.col("n")).alias("weight")), "chosen")
        # At most 2 * SAMPLE short rows, whatever the input: they may be broadcast. Of equal texts one comes back.
        sample = texts.join(F.broadcast(chosen), "key").select("key", "text", "p", "weight").dropDuplicates(["key"])
        best = select(scratch.store(counted(sample), "rates"))
        return train(best, *_featured(sample, best))


def score(docs: DataFrame, model: Classifier, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs plus score (0 to 1) of the whole text; null is empty. The score replaces a column of that name."""
    s = Sealed(docs, text_col)
    text = s.inner[text_col]
    df = s.df if keep_text else s.df.withColumnRenamed(text, "text__")
    carried = [f for f in df.schema.fields if f.name != "text__"]
    at = df.columns.index(text if keep_text else "text__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in carried], pa.array(scores, pa.float64())], names=[*[f.name for f in carried], "score__"])

    out = df.mapInArrow(run, StructType([*carried, StructField("score__", DoubleType())]))
    old = [F.col(s.inner[n]).alias(n) for n in s.names if n != "score" and (keep_text or n != text_col)]
    return out.select(*old, F.col("score__").alias("score"))
