"""Text, links and metadata of HTML pages, as Column expressions and as a parser inside a pandas UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed values.
SKIPPED = ("script", "style", "template", "noscript", "svg", "head", "iframe")
CHROME = ("nav", "header", "footer", "aside")
BLOCKS = (
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Visible lines of a page; main: those of the main landmark, or of the page without its chrome."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.out = [], [], []

    def _flush(self):
        line = " ".join("".join(self.parts).split())
        if line:
            tags = [t for t, _, _ in self.stack]
            inner = any(t in ("main", "article", "section") for t in tags)
            chrome = any(t in ("nav", "aside") or (t in ("header", "footer") and not inner) for t in tags)
            self.out.append((line, any(m for _, _, m in self.stack), chrome))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return
        a = dict(attrs)
        off = tag in SKIPPED or "hidden" in a or bool(HIDDEN.search(a.get("style") or ""))
        self.stack.append((tag, off, tag == "main" or a.get("role") == "main"))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        if not any(off for _, off, _ in self.stack):
            self.parts.append(data)


def lines_of(html: str) -> tuple[list[str], list[str]]:
    """(visible lines, main lines)."""
    p = _Lines()
    p.feed(html or "")
    p.close()
    p._flush()
    mains = [x for x, m, _ in p.out if m]
    return [x for x, _, _ in p.out], mains or [x for x, _, c in p.out if not c]


_LINES = StructType([StructField("visible", ArrayType(StringType())), StructField("main", ArrayType(StringType()))])


@F.pandas_udf(_LINES)
def page_lines(html: pd.Series) -> pd.DataFrame:
    rows = [lines_of(h) for h in html]
    return pd.DataFrame({"visible": [a for a, _ in rows], "main": [b for _, b in rows]})


def title(html) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def links(html) -> Column:
    """The href values, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


def plain(html) -> Column:
    """Text without scripts, styles, comments and tags; spaces collapsed. Entities stay."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))


def fingerprint(lines) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def substance(lines) -> Column:
    """How much running text there is: roots of the lengths beyond 140 characters."""
    return F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.sqrt(F.greatest(F.char_length(x) - 140, F.lit(0)).cast("double")))
