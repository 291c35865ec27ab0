"""http(s) addresses: references resolved against a base, hosts in their one form, and what a URL is identified by.

Built-in functions do it all, but for names beyond ASCII, which Python turns into their ASCII form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that no host holds, and those that a path, or a query, holds only as escapes.
FORBIDDEN = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
IN_PATH = r"[^\x21-\x7E]|[\"<>^`{}]"
IN_QUERY = r"[^\x21-\x7E]|[\"<>']"
LONGEST = 8192

_REST = r"^([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _ascii_name(host: str) -> str | None:
    out = []
    for label in unicodedata.normalize("NFKC", host.lower()).replace("。", ".").split("."):
        if not label.isascii():
            label = "xn--" + label.encode("punycode").decode()
        elif label.startswith("xn--"):
            try:
                known = label[4:].encode().decode("punycode")
            except UnicodeError:
                return None
            if known.isascii() or any(unicodedata.category(c)[0] == "C" for c in known):  # no name has such a form
                return None
        out.append(label)
    return ".".join(out)


@F.pandas_udf(StringType())
def _ascii_host(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda h: None if h is None else _ascii_name(h))


def escaped(x, what: str) -> Column:
    """The text with each character that fits `what` as the escapes of its bytes; escapes stay as they are."""
    x = _c(x)
    each = F.transform(F.split(x, ""), lambda c: F.when(c.rlike(what), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(x.rlike(what), F.array_join(each, "")).otherwise(x)


def without_dots(path) -> Column:
    """An absolute path without '.' and '..' segments, escaped dots included: a stack of segments, folded over the path."""
    segments = F.split(F.substring(_c(path), 2, LONGEST), "/")
    one, two = (lambda s: F.lower(s).isin(".", "%2e")), (lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"))
    stack = F.aggregate(segments, F.array().cast("array<string>"), lambda held, s: F.when(two(s), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(one(s), held).otherwise(F.concat(held, F.array(s))))
    last = F.element_at(segments, -1)
    stack = F.when(one(last) | two(last), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def _number(part: Column) -> Column:
    """A part of an address in decimal, octal (0...) or hexadecimal (0x...); null for anything else."""
    low = F.lower(part)
    hexa, octal = low.rlike("^0x[0-9a-f]*$"), low.rlike("^0[0-7]+$")
    of = lambda digits, base: F.conv(digits, base, 10).cast("decimal(20,0)").cast("double")
    return F.when(hexa, F.when(low == "0x", 0.0).otherwise(of(F.substring(low, 3, 20), 16))).when(octal, of(low, 8)).when(low.rlike("^(0|[1-9][0-9]{0,18})$"), low.cast("double"))


def with_host(df: DataFrame, authority: Column, name: str = "host") -> DataFrame:
    """df plus the host of an authority in its one form, null if it isn't valid: without user and port, escapes decoded, in
    lower case and ASCII; an IPv4 address of one to four parts in any base as four decimal numbers."""
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", "")
    d = df.withColumn("bare__", bare)
    d = d.withColumn("low__", F.lower(F.when(F.contains("bare__", F.lit("%")), F.try_url_decode(F.replace("bare__", F.lit("+"), F.lit("%2B")))).otherwise(F.col("bare__"))))
    d = d.withColumn("name__", F.when(F.col("low__").rlike(r"[^\x00-\x7F]|xn--"), _ascii_host("low__")).otherwise(F.col("low__")))
    d = d.withColumn("parts__", F.split(F.regexp_replace("name__", r"\.$", ""), r"\."))
    d = d.withColumn("numbers__", F.transform("parts__", _number))
    n, last = F.size("parts__"), F.element_at("numbers__", -1)
    front = F.slice("numbers__", F.lit(1), n - 1)
    fits = (n <= 4) & F.forall("numbers__", lambda v: v.isNotNull()) & F.forall(front, lambda v: v <= 255) & (last < F.pow(F.lit(256.0), 5 - n))
    d = d.withColumn("whole__", F.when(fits, F.aggregate(front, F.struct(F.lit(0.0).alias("v"), F.lit(3.0).alias("p")), lambda s, v: F.struct((s["v"] + v * F.pow(F.lit(256.0), s["p"])).alias("v"), (s["p"] - 1).alias("p")))["v"] + last))
    dotted = F.concat_ws(".", *[F.floor(F.col("whole__") / 256**k).cast("long") % 256 for k in (3, 2, 1, 0)])
    numeric = F.element_at("parts__", -1).rlike(r"^([0-9]+|0[xX][0-9A-Fa-f]*)$")
    h = F.col("name__")
    found = F.when(h.rlike(r"^\[[0-9a-f:.]+\]$"), h).when((h != "") & ~h.rlike(FORBIDDEN), F.when(numeric, F.when(F.col("whole__").isNotNull(), dotted)).otherwise(h))
    return d.withColumn(name, found).drop("bare__", "low__", "name__", "parts__", "numbers__", "whole__")


def resolved(df: DataFrame, base: Column, reference: Column, name: str = "url") -> DataFrame:
    """df plus struct(scheme, user, host, port, path, query, fragment) of a reference as the page at `base` means it, null if
    that is no valid http(s) address.

    Without a base (null) the reference must have a scheme. A backslash counts as a slash before the query, white space at
    the ends and line breaks don't count, and default ports are left out. The steps are columns of a frame, so that each is
    computed once.
    """
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    slashed = lambda x: F.concat(F.translate(F.regexp_extract(x, r"^[^?#]*", 0), "\\", "/"), F.regexp_extract(x, r"^[^?#]*(.*)$", 1))
    pattern = r"(?i)^(https?):/*([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    c = {k: F.col(f"{k}__") for k in ("ref", "base", "b_scheme", "b_path", "named", "after", "relative", "given", "alone", "r_path", "scheme", "authority", "port", "path", "query", "host")}
    d = df.withColumns({"ref__": clean(reference), "base__": clean(base)}).withColumns({"ref__": slashed(c["ref"]), "base__": slashed(c["base"])})
    d = d.withColumns({
        "b_scheme__": F.coalesce(F.lower(F.regexp_extract(c["base"], pattern, 1)), F.lit("")),
        "b_path__": F.regexp_extract(c["base"], pattern, 3),
        "named__": F.lower(F.regexp_extract(c["ref"], r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "after__": F.regexp_replace(c["ref"], r"^[A-Za-z][A-Za-z0-9+.-]*:", ""),
    })
    d = d.withColumn("relative__", (c["b_scheme"] != "") & ((c["named"] == "") | ((c["named"] == c["b_scheme"]) & ~c["after"].startswith("/"))))
    d = d.withColumn("alone__", ~c["relative"] | c["after"].startswith("//"))
    d = d.withColumn("given__", F.when(c["alone"], F.regexp_replace("after__", "^/*", "")).otherwise(c["after"]))
    d = d.withColumns({
        "r_path__": F.regexp_extract("after__", "^[^?#]*", 0),
        "scheme__": F.when(c["named"] == "", c["b_scheme"]).otherwise(c["named"]),
        "authority__": F.when(c["alone"], F.regexp_extract("given__", _REST, 1)).otherwise(F.regexp_extract(c["base"], pattern, 2)),
    })
    up_to = F.regexp_extract(F.when(c["b_path"] == "", "/").otherwise(c["b_path"]), r"^(.*/)[^/]*$", 1)
    own = F.when(F.contains(F.regexp_extract("given__", "^[^#]*", 0), F.lit("?")), F.regexp_extract("given__", r"^[^?#]*\?([^#]*)", 1))
    b_query = F.when(F.contains(F.regexp_extract("base__", "^[^#]*", 0), F.lit("?")), F.regexp_extract(c["base"], pattern, 4))
    d = d.withColumns({
        "path__": F.when(c["alone"], F.regexp_extract("given__", _REST, 2)).when(c["r_path"].startswith("/"), c["r_path"]).when(c["r_path"] == "", c["b_path"]).otherwise(F.concat(up_to, c["r_path"])),
        "query__": F.when(~c["alone"] & (c["r_path"] == "") & own.isNull(), b_query).otherwise(own),
        "port__": F.regexp_extract("authority__", r":([0-9]+)$", 1).try_cast("int"),
    })
    d = d.withColumns({"path__": escaped(F.when(c["path"] == "", "/").otherwise(c["path"]), IN_PATH), "query__": escaped(c["query"], IN_QUERY)})
    d = with_host(d, c["authority"], "host__")
    default = ((c["scheme"] == "http") & (c["port"] == 80)) | ((c["scheme"] == "https") & (c["port"] == 443))
    ok = c["scheme"].isin("http", "https") & c["host"].isNotNull() & F.coalesce(c["port"] <= 65535, F.lit(True)) & ~c["authority"].rlike(r":[^\]0-9@][^@\]]*$")
    user = F.when(F.contains("authority__", F.lit("@")), F.regexp_extract("authority__", "^(.*)@", 1))
    fragment = F.when(F.contains("given__", F.lit("#")), F.regexp_extract("given__", r"^[^#]*#(.*)$", 1))
    made = F.struct(c["scheme"].alias("scheme"), user.alias("user"), c["host"].alias("host"), F.when(~F.coalesce(default, F.lit(False)), c["port"]).alias("port"), without_dots("path__").alias("path"), c["query"].alias("query"), fragment.alias("fragment"))
    return d.withColumn("made__", F.when(ok, made)).select(*[x for x in df.columns if x != name], F.col("made__").alias(name))


def text(url) -> Column:
    """A resolved address as text."""
    u = _c(url)
    some = lambda mark, x: F.when(x.isNull(), "").otherwise(F.concat(F.lit(mark), x))
    user = F.when(u["user"].isNull() | (u["user"] == ""), "").otherwise(F.concat(u["user"], F.lit("@")))
    return F.concat(u["scheme"], F.lit("://"), user, u["host"], some(":", u["port"].cast("string")), u["path"], some("?", u["query"]), some("#", u["fragment"]))


def identity(url, tracking: tuple[str, ...] = (), sort_query: bool = False, collapse_slashes: bool = False) -> Column:
    """What a resolved address is known by: itself without its fragment, null with credentials or beyond LONGEST bytes;
    tracking parameters left out, parameters sorted and runs of slashes collapsed if asked."""
    u = _c(url)
    pairs = F.split(u["query"], "&")
    pairs = F.filter(pairs, lambda p: ~F.element_at(F.split(p, "="), 1).isin(*tracking)) if tracking else pairs
    pairs = F.array_sort(pairs) if sort_query else pairs
    query = F.when(F.size(pairs) > 0, F.array_join(pairs, "&")) if tracking or sort_query else u["query"]
    path = F.regexp_replace(u["path"], "/+", "/") if collapse_slashes else u["path"]
    plain = F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"].isNull(), "").otherwise(F.concat(F.lit(":"), u["port"].cast("string"))), path, F.when(query.isNull(), "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((F.octet_length(plain) <= LONGEST) & F.coalesce(u["user"] == "", F.lit(True)), plain)
