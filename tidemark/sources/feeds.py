"""RSS, Atom and sitemap documents as rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

ITEM = "key string, title string, link string, published string, summary string"
PLACE = "key string, loc string, lastmod string, is_index boolean"
#: The deepest tree, and the most bytes that a packed document may have.
DEEPEST, MOST_BYTES = 64, 50 << 20


def _parse(raw: bytes) -> ElementTree.Element | None:
    """The root; none for a document with a DTD, one that is too deep, too large when unpacked, damaged, or not well formed."""
    if raw[:2] == b"\x1f\x8b":
        packed = zlib.decompressobj(31)
        try:
            raw = packed.decompress(raw, MOST_BYTES)
        except zlib.error:
            return None
        if not packed.eof:
            return None
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        return None
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None
    level, deep = [root], 0
    while level:
        deep, level = deep + 1, [c for n in level for c in n]
    return root if deep <= DEEPEST else None


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(node, *names: str) -> str | None:
    for c in node:
        if _name(c.tag) in names:
            if _name(c.tag) == "link" and c.get("href"):
                return c.get("href")
            return "".join(c.itertext()).strip() or None
    return None


def items(raw: bytes) -> list[tuple]:
    root = _parse(raw)
    if root is None:
        return []
    nodes = [n for n in root.iter() if _name(n.tag) in ("item", "entry")]
    return [(_child(n, "title"), _child(n, "link"), _child(n, "pubDate", "published", "updated", "date"), _child(n, "description", "summary", "content")) for n in nodes]


def places(raw: bytes) -> list[tuple]:
    root = _parse(raw)
    if root is None or _name(root.tag) not in ("urlset", "sitemapindex"):
        return []
    out = [(_child(n, "loc"), _child(n, "lastmod"), _name(root.tag) == "sitemapindex") for n in root if _name(n.tag) in ("url", "sitemap")]
    return [x for x in out if x[0]]


def _rows(read, width: int, kinds: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *x) for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in read(raw or b"")]
            cols = list(zip(*out, strict=True)) if out else [()] * width
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[str(i) for i in range(width)])

    return run


def feed_items(documents: DataFrame, key: str, body: str) -> DataFrame:
    """A row per item of the RSS or Atom documents in body (bytes); refused documents give none."""
    s = pa.string()
    return documents.selectExpr(f"cast({key} as string) k", f"cast({body} as binary) b").mapInArrow(_rows(items, 5, [s] * 5), ITEM)


def sitemap_entries(documents: DataFrame, key: str, body: str) -> DataFrame:
    s = pa.string()
    return documents.selectExpr(f"cast({key} as string) k", f"cast({body} as binary) b").mapInArrow(_rows(places, 4, [s, s, s, pa.bool_()]), PLACE)
