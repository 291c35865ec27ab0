"""Quality rules by robust multivariate outliers.

Each document has a vector of transformed statistics. For each language and source, minimum-covariance-determinant
estimates of its centre and spread are found by concentration steps from several starts: distances of all rows, the
nearest share of them, and the moments of those, each as one Spark aggregation. The start that leads to the least
determinant holds. Starts and scales come from each part's shortest half, so that up to a third of a group's rows may be
junk. A document too far by Mahalanobis distance is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Scratch, Sealed, store

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
#: The vector's parts.
PARTS = ("x0", "x1", "x2", "x3", "x4")
P = len(PARTS)
#: The largest condition number that a correlation matrix may have, and the shares of the unit matrix tried to get there.
CONDITION, SHARES = 100.0, (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
#: Concentration steps after which the best start is chosen, and steps at most.
TRIAL, STEPS = 3, 30
#: The share of a group's rows that an estimate is made of, and rows of a group at least.
SHARE, LEAST = 0.65, 100
#: Whatever the distribution, at most this share of it has a squared distance beyond P / TAIL (Chebyshev's inequality).
TAIL = 1 / 16
_SYMBOLS, _SPACES = np.array([ord(c) for c in SYMBOLS]), np.array([9, 10, 11, 12, 13, 32])


def _repeats(words: list[bytes]) -> int:
    """Words in 5-word windows that the text has twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words)) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for i in range(5):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : n + i]
        h ^= h >> np.uint64(31)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0  # equal windows have equal hashes
    seen: dict[tuple, int] = {}
    first = [seen.setdefault(tuple(words[i : i + 5]), i) for i in range(n)]
    twice = np.bincount(np.array(first), minlength=n) > 1
    at = np.flatnonzero(twice[np.array(first)])
    edge = np.zeros(n + 6, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text, in UTF-8."""
    words = text.split()  # at the six white space bytes
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(by[128:192].sum()) - int(by[_SPACES].sum())
    lines = [x for x in text.split(b"\n") if x.strip()] if by[10] else ([text] if words else [])
    return len(words), chars, int(by[_SYMBOLS].sum()), len(lines) - len(set(lines)), _repeats(words), int(by[65:91].sum()), len(lines)


def measure(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus the COUNTS of the whole text, which replace columns of these names. A null text has no words."""
    s = Sealed(docs, text_col)
    text = s.inner[text_col]
    df = s.df.withColumn("t__", F.coalesce(F.col(text), F.lit("")).cast("binary"))
    df = df if keep_text else df.drop(text)
    carried = [f for f in df.schema.fields if f.name != "t__"]
    new = [StructField(f"{c}__", LongType()) for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(x.as_py()) for x in b.column("t__")]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in carried] + cols, names=[f.name for f in carried + new])

    out = df.mapInArrow(run, StructType(carried + new))
    old = [F.col(s.inner[n]).alias(n) for n in s.names if n not in COUNTS and (keep_text or n != text_col)]
    return out.select(*old, *[F.col(f"{c}__").alias(c) for c in COUNTS])


def vector() -> dict[str, Column]:
    """The parts, from COUNTS. Ratios are logs of counts with something added, so that a text without any has one too: it
    says the less the shorter the text is, and no part is nearly the same for all."""
    c = {n: F.col(n).cast("double") for n in COUNTS}
    ratio = lambda a, b, more: F.log((a + more) / (b + more))
    return {
        "x0": F.log((c["word_chars"] + 50) / (c["n_words"] + 10)),  # ten more words of five letters
        "x1": ratio(c["n_symbols"], c["n_words"], 1),
        "x2": ratio(c["n_dup_lines"], c["n_lines"], 1),
        "x3": ratio(c["n_repeat_words"], c["n_words"], 5),  # a repeat has five words at least
        "x4": ratio(c["n_upper"], c["word_chars"], 1),
    }


def base_failed(min_words: int = 10, most_repeats: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def chi2_quantile(q: float, p: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(q)
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _distance(parts: tuple[str, ...] = PARTS, mu: str = "mu", inv: str = "inv") -> Column:
    """Squared Mahalanobis distance of the vector to mu under inv, a symmetric matrix by rows."""
    x = [F.col(n) - F.col(mu)[i] for i, n in enumerate(parts)]
    out = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            out = out + x[i] * x[j] * F.col(inv)[i * P + j] * (1 if i == j else 2)
    return out


_FIT = "lang_ string, source_ string, level int, start int, n long, mu array<double>, inv array<double>, var array<double>, det double"
_NAMES = [c.split()[0] for c in _FIT.split(", ")]
#: The probabilities at which a part's quantiles are taken.
_GRID = [i / 100 for i in range(101)]


def shortest_half(q: np.ndarray) -> tuple[float, float]:
    """(middle, variance) of normal data with the same shortest half, from quantiles at 0, 0.01, ..., 1. Less than half of
    the rows, whatever they are, move it little."""
    width = q[50:] - q[:51]
    i = int(width.argmin())
    return float(q[i + 25]), float((width[i] / 1.349) ** 2)


def regular(cov: np.ndarray, var: np.ndarray) -> np.ndarray:
    """cov itself if its condition number, in units of the variances var, is at most CONDITION; else the mean of cov
    and those variances with the least of SHARES that gets it there."""
    sd = np.sqrt(np.maximum(var, 1e-12))
    k = cov / np.outer(sd, sd)
    for share in SHARES:
        m = (1 - share) * k + share * np.eye(len(sd))
        w = np.linalg.eigvalsh(m)
        if w[0] > 0 and w[-1] <= CONDITION * w[0]:
            break
    return m * np.outer(sd, sd)


def _solved(cov: np.ndarray, var: np.ndarray, scale: float) -> tuple[list[float], float]:
    """(the inverse by rows, the log of the determinant) of a covariance."""
    m = regular(cov, var) * scale
    return np.linalg.inv(m).ravel().tolist(), float(np.linalg.slogdet(m)[1])


def _moments(r: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    m = np.array([r[f"m{i}"] for i in range(P)])
    return m, np.array([[r[f"c{min(i, j)}{max(i, j)}"] for j in range(P)] for i in range(P)]) - np.outer(m, m)


def _begin(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each group's quantiles and moments to its starts: the middle of the shortest halves with their spread, and the
    median with the whole covariance, and with the whole variances. The spread of the shortest halves is the scale that
    covariances are held against."""
    for b in rows:
        out = []
        for _, r in b.iterrows():
            _, cov = _moments(r)
            every = np.maximum(np.diag(cov), 1e-12)
            q = [np.array(r[f"q{i}"]) for i in range(P)]
            mid, wide = zip(*map(shortest_half, q), strict=True)
            var = np.where(np.array(wide) > 0, wide, every)
            median = [float(x[50]) for x in q]
            for start, (mu, c) in enumerate(((list(mid), np.diag(var)), (median, cov), (median, np.diag(every)))):
                out.append((r["lang_"], r["source_"], r["level"], start, r["n"], mu, _solved(c, var, 1.0)[0], var.tolist(), np.inf))
        yield pd.DataFrame(out, columns=_NAMES)


def _concentrate(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the moments of each group's nearest rows to its centre, inverse covariance and determinant."""
    for b in rows:
        out = []
        for _, r in b.iterrows():
            m, cov = _moments(r)
            inv, det = _solved(cov, np.array(r["var"]), r["scale"])
            out.append((r["lang_"], r["source_"], r["level"], r["start"], r["n"], m.tolist(), inv, list(r["var"]), det))
        yield pd.DataFrame(out, columns=_NAMES)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["lang_"].eqNullSafe(b["lang_"]) & a["source_"].eqNullSafe(b["source_"]) & (a["level"] == b["level"])


def fit(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Estimates (lang_, source_, level, start, n, mu, inv, var, det, still): level 0 by language and source, 1 by language,
    2 over all.

    Only rows that pass base_failed() are used. Concentration steps go from three starts; after TRIAL of them the one of
    least determinant goes on, until no group's determinant falls any more (STEPS at most; `still` tells whether the
    group's did not in the last step). A covariance too near to a singular one is drawn to the group's own spread as far
    as that takes (regular()). Groups under `least` rows get no estimate; judge() then takes the next level and says so.
    Quantiles are Spark's mergeable ones, so no group is gathered in one place.
    """
    v = vector()
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    levels = F.explode(F.array(*[F.struct((lang if k < 2 else F.lit(None).cast("string")).alias("lang_"), (source if k < 1 else F.lit(None).cast("string")).alias("source_"), F.lit(k).alias("level")) for k in range(3)]))
    by = ["lang_", "source_", "level"]
    moments = [F.avg(n).alias(f"m{i}") for i, n in enumerate(PARTS)]
    moments += [F.avg(F.col(a) * F.col(b)).alias(f"c{i}{j}") for i, a in enumerate(PARTS) for j, b in enumerate(PARTS) if i <= j]
    with Scratch(measured.sparkSession, "quality") as scratch:
        x = measured.where(~base_failed()).select(levels.alias("g"), *[c.alias(n) for n, c in v.items()]).select("g.*", *PARTS)
        x = scratch.store(x, "vectors")
        quartiles = [F.percentile_approx(n, _GRID, 2000).alias(f"q{i}") for i, n in enumerate(PARTS)]
        first = x.groupBy(*by).agg(F.count("*").alias("n"), *quartiles, *moments).where(F.col("n") >= least)
        est, finished = scratch.store(first.mapInPandas(_begin, _FIT), "fit-0"), None
        for step in range(1, STEPS + 1):
            d = x.join(est, _same(x, est)).select(*[x[c] for c in by], "start", *PARTS, "n", "var", "det", _distance().alias("d"))
            near = scratch.store(d.groupBy(*by, "start").agg(F.percentile_approx("d", share, 2000).alias("cut")), f"cut-{step}")
            inner = d.join(near, _same(d, near) & (d["start"] == near["start"]) & (d["d"] <= near["cut"])).select(*[d[c] for c in by], d["start"], "n", "var", "det", *PARTS)
            # The covariance of the inner share is too small by this factor for normal data.
            sums = inner.groupBy(*by, "start").agg(F.first("n").alias("n"), F.first("var").alias("var"), *moments).withColumn("scale", F.lit(share / _inner_mass(share)))
            new = sums.mapInPandas(_concentrate, _FIT)
            if step == TRIAL:
                best = F.row_number().over(Window.partitionBy(*by).orderBy("det", "start"))
                new = new.withColumn("rank_", best).where("rank_ = 1").drop("rank_")
            new = scratch.store(new, f"fit-{step}")
            if step <= TRIAL:
                est = new
                continue
            was = est.select(*by, F.col("det").alias("was_"))
            marked = scratch.store(new.join(was, _same(new, was)).select(*[new[c] for c in _NAMES], (was["was_"] - new["det"] < 1e-3).alias("still")), f"marked-{step}")
            # A group that is still takes no further steps.
            done = marked.where("still") if step < STEPS else marked
            finished = done if finished is None else finished.unionByName(done)
            est = marked.where("NOT still").drop("still")
            if est.isEmpty():
                break
        return scratch.keep(finished, "fit")


def _inner_mass(share: float) -> float:
    """P(chi2 with P+2 degrees <= the share's quantile of chi2 with P degrees)."""
    q = chi2_quantile(share, P)
    k = P + 2
    return NormalDist().cdf(((q / k) ** (1 / 3) - (1 - 2 / (9 * k))) / (2 / (9 * k)) ** 0.5)


def judge(measured: DataFrame, fitted: DataFrame, lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """measured plus base_failed, distance (squared; null where no group is large enough), kept, level (0: by the estimate
    of language and source, 1: of the language, 2: of all, null: none) and still (whether that estimate had converged),
    which replace columns of these names.

    kept: the base rules hold, and the distance is at most P / tail. A document whose groups are all too small for an
    estimate is kept if the base rules hold.
    """
    new = ("base_failed", "distance", "kept", "level", "still")
    s = Sealed(measured, lang_col, source_col, *COUNTS)
    parts = tuple(f"{n}__" for n in PARTS)
    m = s.df.select("*", *[s[c].alias(c) for c in COUNTS])
    m = m.select(*s.inner.values(), base_failed().alias("failed__"), *[c.alias(n) for n, c in zip(parts, vector().values(), strict=True)])
    lang, source = s[lang_col].cast("string"), s[source_col].cast("string")
    for k in range(3):
        f = fitted.where(F.col("level") == k).select(F.col("lang_").alias(f"l{k}__"), F.col("source_").alias(f"s{k}__"), F.struct("mu", "inv", "level", "still").alias(f"fit{k}__"))
        on = f[f"l{k}__"].eqNullSafe(lang if k < 2 else F.lit(None)) & f[f"s{k}__"].eqNullSafe(source if k < 1 else F.lit(None))
        m = m.join(f, on, "left")
    m = m.withColumn("fit__", F.coalesce(*[f"fit{k}__" for k in range(3)]))
    m = m.withColumn("d__", _distance(parts, "fit__.mu", "fit__.inv"))
    kept = ~F.col("failed__") & F.coalesce(F.col("d__") <= P / tail, F.lit(True))
    old = [s[n].alias(n) for n in s.names if n not in new]
    return m.select(*old, F.col("failed__").alias("base_failed"), F.col("d__").alias("distance"), kept.alias("kept"), F.col("fit__.level").alias("level"), F.col("fit__.still").alias("still"))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the documents that the quality rules reject, with the columns of docs."""
    s = Sealed(docs, "lang", "source", "text")
    i = s.inner
    inner = s.df
    fitted = fit(measure(inner.select(i["lang"], i["source"], i["text"]), i["text"], keep_text=False), i["lang"], i["source"])
    good = judge(measure(inner, i["text"]), fitted, i["lang"], i["source"]).where("kept")
    return s.replace(good)
