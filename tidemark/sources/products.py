"""Products stated by a page: JSON-LD, microdata and OpenGraph, as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

FIELDS = ("source", "name", "brand", "sku", "gtin", "price", "currency", "availability", "url")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """JSON-LD texts, meta properties, and the items of microdata with their properties."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.scripts, self.meta, self.items = [], {}, []
        self.open, self.tags, self.in_ld = [], [], False

    def _value(self, tag, a):
        for want, names in (("content", ("meta",)), ("href", ("a", "link", "area")), ("src", ("img", "source")), ("datetime", ("time",)), ("value", ("data", "meter"))):
            if tag in names and a.get(want) is not None:
                return a[want]
        return a.get("content")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.in_ld = True
            self.scripts.append("")
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault((a.get("property") or a["name"]).lower(), a.get("content", ""))
        mark, prop = None, a.get("itemprop")
        if "itemscope" in a:
            item = {"@type": a.get("itemtype", "").rstrip("/").rpartition("/")[2]}
            if prop and self.open:
                self.open[-1].setdefault(prop.split()[0], item)
            else:
                self.items.append(item)
            self.open.append(item)
            mark = "scope"
        elif prop and self.open:
            value = self._value(tag, a)
            if value is not None:
                for p in prop.split():
                    self.open[-1].setdefault(p, value)
            else:
                mark = ("text", prop.split(), [])
        if tag not in _VOID:
            self.tags.append((tag, mark))

    def handle_endtag(self, tag):
        if tag == "script":
            self.in_ld = False
        at = next((i for i in range(len(self.tags) - 1, -1, -1) if self.tags[i][0] == tag), None)
        if at is None:
            return
        for _, mark in reversed(self.tags[at:]):
            if mark == "scope":
                self.open.pop()
            elif mark and self.open:
                for p in mark[1]:
                    self.open[-1].setdefault(p, " ".join("".join(mark[2]).split()))
        del self.tags[at:]

    def handle_data(self, data):
        if self.in_ld:
            self.scripts[-1] += data
        for _, mark in self.tags:
            if mark and mark != "scope":
                mark[2].append(data)


def _nodes(x) -> Iterator[dict]:
    stack = [x]
    while stack:
        n = stack.pop(0)
        if isinstance(n, list):
            stack = n + stack
        elif isinstance(n, dict):
            yield n
            stack = [v for v in n.values() if isinstance(v, dict | list)] + stack


def _text(x) -> str | None:
    if isinstance(x, list):
        x = x[0] if x else None
    if isinstance(x, dict):
        x = x.get("name") or x.get("@id")
    return None if x is None or isinstance(x, bool) else str(x).strip() or None


def _product(n: dict, source: str) -> tuple:
    offer = n.get("offers") or {}
    offer = (offer[0] if offer else {}) if isinstance(offer, list) else offer
    offer = offer if isinstance(offer, dict) else {}
    gtin = next((_text(n[k]) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin") if n.get(k)), None)
    price = offer.get("price", offer.get("lowPrice"))
    return source, _text(n.get("name")), _text(n.get("brand")), _text(n.get("sku")), gtin, _text(price), _text(offer.get("priceCurrency")), _text(offer.get("availability")), _text(offer.get("url") or n.get("url"))


def extract(html: str | None) -> list[tuple]:
    """FIELDS of each product that the page states, in the order JSON-LD, microdata, OpenGraph. Prices keep their text."""
    p = _Page()
    p.feed(html or "")
    p.close()
    out = []
    for s in p.scripts:
        try:
            tree = json.loads(s, parse_float=str, parse_int=str)
        except ValueError:
            continue
        for n in _nodes(tree):
            kinds = n.get("@type")
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                out.append(_product(n, "JSON_LD"))
    for i in p.items:
        for n in _nodes(i):
            if n.get("@type") == "Product":
                out.append(_product(n, "MICRODATA"))
    m = p.meta
    if m.get("og:type", "").lower() in ("product", "og:product"):
        get = lambda *ks: next((m[k] for k in ks if m.get(k)), None)
        out.append(("OPEN_GRAPH", get("og:title"), get("product:brand", "og:brand"), get("product:retailer_item_id"), get("product:ean", "product:gtin"), get("product:price:amount", "og:price:amount"), get("product:price:currency", "og:price:currency"), get("product:availability", "og:availability"), get("og:url")))
    return out


def products(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row per stated product: key, then FIELDS. Pages without any give none; what isn't stated is null."""
    names = ["key", *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *x) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in extract(h)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)

    return pages.selectExpr(f"cast({key} as string) key", f"{html} html").mapInArrow(run, ", ".join(f"{n} string" for n in names))
