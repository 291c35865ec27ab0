"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered with a mark before and after each turn, encoded once with offsets, and the sorted
spans of its assistant turns are intersected with the token spans by binary search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks. Each is one added token of the encoder, so no token crosses the seam of a turn.
OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|done|>"

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Every '<|' gets a backslash in between, and every '<\\...|' one more: no mark is left, and unescape() undoes it."""
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """render() undone."""
    turns = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, body = turn.removesuffix(CLOSE).partition(SEP)
        turns.append((unescape(role), unescape(body)))
    return turns


@lru_cache(maxsize=2)
def encoder(path: str):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel):
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (OPEN, SEP, CLOSE)])
    return t


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether it lies in one of the sorted spans; found by binary search."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    s = np.array(spans)
    at = np.searchsorted(s[:, 0], offsets[:, 0], side="right") - 1
    inside = s[np.maximum(at, 0)]
    return (at >= 0) & (offsets[:, 0] >= inside[:, 0]) & (offsets[:, 1] <= inside[:, 1]) & (offsets[:, 1] > offsets[:, 0])


def covered(formatted: str, offsets: np.ndarray, on: np.ndarray) -> list[str]:
    """The text under the mask, one string for each run of it. Tokens of one character in parts overlap."""
    o = offsets[on]
    if not len(o):
        return []
    cut = np.flatnonzero(o[1:, 0] > o[:-1, 1]) + 1
    return [formatted[o[i, 0] : o[j - 1, 1]] for i, j in zip(np.r_[0, cut], np.r_[cut, len(o)], strict=True)]


_SCHEMA = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, n_turns long"


def _format(path: str, id_type: pa.DataType):
    def one(key, turns):
        text, spans = render(turns)
        e = encoder(path).encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        on = mask(offsets, spans)
        return key, text, e.ids, offsets[:, 0].tolist(), offsets[:, 1].tolist(), on.tolist(), len(turns)

    def out(rows):
        kinds = [id_type, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64()]
        names = ["conv", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask", "n_turns"]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted turns in, so only one conversation is held."""
        rows, size, key, turns, begun = [], 0, None, [], False
        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and c != key:
                    rows.append(one(key, turns))
                    size += len(rows[-1][1])
                    turns = []
                    if size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                key, begun = c, True
                turns.append((role or "", text or ""))
        if begun:
            rows.append(one(key, turns))
        yield out(rows)

    return run


def format_conversations(turns: DataFrame, path: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, token_ids, token_starts, token_ends (in code points), loss_mask, n_turns.

    Turns go by number, null last, ties by role, then text; repeated rows are turns of their own. A null role or text is
    empty; assistant turns alone are under the mask; an empty one adds nothing to it. A null id is one conversation.
    Conversations are dealt out by id and read in order, so a task holds one of them at a time, whatever its length.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    t = turns.select(F.col(id_col).alias("conv"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    kind = t.schema["conv"].dataType
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = t.repartition("conv").sortWithinPartitions(*order).select("conv", "role", "text")
    made = ordered.mapInArrow(_format(path, to_arrow_type(kind)), f"conv {kind.simpleString()}, {_SCHEMA}")
    return made.withColumnRenamed("conv", id_col)


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted rows hold, read back from them: turns, and the text under the mask, both unescaped."""
    from hashlib import sha256

    kind = formatted.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, a, z, on in zip(*(b.column(c) for c in ("formatted", "token_starts", "token_ends", "loss_mask")), strict=True):
                s = text.as_py()
                turns = parse(s)
                offsets = np.stack([np.array(a.values), np.array(z.values)], 1) if len(a) else np.zeros((0, 2), int)
                flags = np.array(on.values.to_pylist(), dtype=bool)
                loss = "".join(unescape(x) for x in covered(s, offsets, flags))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(s), len(flags), int(flags.sum())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[id_col, *[x.split()[0] for x in _DIGEST.split(", ")]])

    return formatted.select(id_col, "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(run, f"{id_col} {kind.simpleString()}, {_DIGEST}")
