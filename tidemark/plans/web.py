"""Queries over pages and packed sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import web as w
from tidemark.sources import packed

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("page_plain", f"SELECT page_id, length({PLAIN}) AS n, sha256({PLAIN}) AS digest FROM pages")
def page_plain(spark, sf_dir):
    p = w.plain(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(p).cast("long").alias("n"), F.sha2(p, 256).alias("digest"))


@query("page_links", r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(w.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("page_title", r"SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", w.title(F.col("html")).alias("title"))


@query("page_lines")
def page_lines(spark, sf_dir):
    """Visible and main lines by the HTML parser, their fingerprints and substance."""
    p = table(spark, sf_dir, "pages").select("page_id", w.page_lines("html").alias("x"))
    return p.select("page_id", F.size("x.visible").alias("visible"), F.size("x.main").alias("main"), w.fingerprint(F.col("x.main")).alias("fingerprint"), F.round(w.substance(F.col("x.main")), 6).alias("substance"))


@query("host_counts", r"SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, count(*) AS n, sum(length(html)) AS chars FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(F.char_length("html")).alias("chars"))


@query("verified_captures", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def verified_captures(spark, sf_dir):
    """Captures whose bytes match their digest; a third is recorded with a wrong one."""
    p = table(spark, sf_dir, "pages").withColumn("digest", F.when(F.col("page_id") % 3 != 0, F.sha2("html", 256)).otherwise(F.sha2("url", 256)))
    return packed.verified(p, "html", "digest").select("page_id")


@query("packed_series", "SELECT user_id, 1293840000 + 60 * k AS ts, CASE WHEN v >= 0 THEN v END AS value FROM (SELECT user_id, CAST(event_id AS BIGINT) AS k, CAST(floor(value) AS BIGINT) - 20 AS v FROM events)")
def packed_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.array("event_id", F.floor("value").cast("long") - 20).alias("pair"))
    packed_rows = e.groupBy("user_id").agg(F.flatten(F.array_sort(F.collect_list("pair"))).alias("p"))
    return packed.packed_series(packed_rows, ["user_id"], "p")


@query("export_manifest", "SELECT n_regionkey, count(*) AS n, list_reduce(list_prepend(sha256(''), list_sort(list(n_name))), lambda h, r: sha256(h || ':' || sha256(r))) AS manifest FROM nation GROUP BY 1")
def export_manifest(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), packed.export_chain(F.collect_list("n_name")).alias("manifest"))


@query("registrable_domain", r"""SELECT page_id, array_to_string(list_slice(p, greatest(1, len(p) - 1), len(p)), '.') AS site FROM (SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), ':\d+$', ''), '.') AS p FROM pages)""")
def registrable_domain(spark, sf_dir):
    """The last two labels of a host: its registrable domain under single-label suffixes."""
    labels = F.split(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)), r":\d+$", ""), r"\.")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").alias("site"))


LINKS = r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS i FROM pages),
r AS (SELECT page_id, i, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  CASE i % 5 WHEN 0 THEN href WHEN 1 THEN '..' || href WHEN 2 THEN '.' || href || '/./x/../y?q=1#f' WHEN 3 THEN '//Host.EXAMPLE:' || CASE WHEN starts_with(url, 'https') THEN '443' ELSE '8080' END || href ELSE '../../../..' || href || '/..' END AS ref FROM h),
p AS (SELECT *, CASE WHEN starts_with(ref, '//') THEN regexp_replace(ref, '^//[^/]*', '') WHEN starts_with(ref, '/') THEN ref ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) || regexp_extract(ref, '^[^?#]*', 0) END AS raw FROM r),
q AS (SELECT *, list_transform(string_split(substr(raw, 2), '/'), lambda s: [s]) AS seg FROM p),
f AS (SELECT *, list_reduce(list_prepend(['#'], seg), lambda a, x: CASE WHEN x[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END) AS held FROM q),
g AS (SELECT page_id, i, scheme, CASE WHEN starts_with(ref, '//') THEN 'host.example' || CASE WHEN scheme = 'https' THEN '' ELSE ':8080' END ELSE host END AS host, '/' || array_to_string(held[2:], '/') || CASE WHEN regexp_matches(raw, '/\.\.?$') AND len(held) > 1 THEN '/' ELSE '' END AS path, CASE WHEN contains(ref, '?') THEN '?q=1' ELSE '' END AS query FROM f)
SELECT page_id, i, scheme || '://' || host || array_to_string(list_transform(string_split(path, ''), lambda c: CASE WHEN regexp_matches(c, '[^\x00-\x7F]') THEN url_encode(c) ELSE c END), '') || query AS link FROM g"""


@query("resolved_links", LINKS)
def resolved_links(spark, sf_dir):
    """The links of each page, some made relative, as the page means them."""
    from tidemark.functions import urls

    h = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("i", "href"))
    port = F.when(F.col("url").startswith("https"), "443").otherwise("8080")
    k = F.col("i") % 5
    ref = (
        F.when(k == 0, F.col("href"))
        .when(k == 1, F.concat(F.lit(".."), "href"))
        .when(k == 2, F.concat(F.lit("."), "href", F.lit("/./x/../y?q=1#f")))
        .when(k == 3, F.concat(F.lit("//Host.EXAMPLE:"), port, "href"))
        .otherwise(F.concat(F.lit("../../../.."), "href", F.lit("/..")))
    )
    return urls.resolved(h, F.col("url"), ref, "link").select("page_id", F.col("i").cast("long").alias("i"), urls.identity("link").alias("link"))
