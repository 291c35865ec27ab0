"""Text queries over documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stopwords
from tidemark.functions import text as x
from tidemark.operators import phrases
from tidemark.operators.copies import copy_pairs
from tidemark.operators.graph import connected_components, depths
from tidemark.storage import store

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
TERMS = f"list_distinct(list_filter({WORDS}, lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'https', 'http', 'com')))"


@query("terms_document_frequency", f"WITH e AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents) SELECT term, count(*) AS df FROM e GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 20")
def terms_document_frequency(spark, sf_dir):
    return x.document_frequency(table(spark, sf_dir, "documents"), "doc_id", "text").where("df >= 2").orderBy(F.desc("df"), "term").limit(20)


@query("mentions", f"SELECT doc_id FROM documents WHERE list_contains({TERMS}, 'idiot') AND list_contains({TERMS}, 'trash')")
def mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(x.mentions("Idiot, trash", "text")).select("doc_id")


@query("sentiment_labels", f"""SELECT lang, CASE WHEN lang <> 'en' THEN 'UNKNOWN' WHEN p AND n THEN 'MIXED' WHEN p THEN 'POSITIVE' WHEN n THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label, count(*) AS n FROM (
  SELECT lang, list_has_any({WORDS}, ['love', 'excellent', 'great', 'happy', 'good']) AS p, list_has_any({WORDS}, ['hate', 'awful', 'bad', 'broken', 'terrible']) AS n FROM documents) GROUP BY 1, 2""")
def sentiment_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", x.sentiment("text", "lang").alias("label")).agg(F.count("*").alias("n"))


@query("ngram_phrases", f"""WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), g AS (SELECT DISTINCT item_id, item_id % 7 AS author, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w))
SELECT phrase, count(*) AS posts, count(DISTINCT author) AS authors FROM g GROUP BY phrase HAVING count(*) >= 2 AND count(DISTINCT author) >= 2""")
def ngram_phrases(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", x.words("text").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))
    g = w.where(F.size("w") >= 2).select("item_id", (F.col("item_id") % 7).alias("author"), F.explode(F.array_distinct(pairs)).alias("phrase"))
    p = g.groupBy("phrase").agg(F.count("*").alias("posts"), F.count_distinct("author").alias("authors"))
    return p.where("posts >= 2 AND authors >= 2")


COPY = """WITH s AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT item_id + 100000, text || ' Again.' FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT item_id + 200000, substr(text, 1, 70) FROM benchmark WHERE item_id % 5 = 0),
t AS (SELECT id, trim(regexp_replace(lower(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: NOT (w LIKE 'http%' OR w LIKE 'www.%' OR contains(w, '/'))), ' ')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM s),
g AS (SELECT id, length(t) AS c, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, CAST(i AS BIGINT), 5))) AS g FROM t WHERE length(t) >= 12),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS na, len(b.g) AS nb, least(a.c, b.c) AS c FROM g a JOIN g b ON a.id < b.id),
l AS (SELECT a, b FROM p WHERE i >= 0.8 * (na + nb - i) OR (c >= 40 AND i >= 0.9 * least(na, nb))) """


def _copied(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    again = b.where("id % 4 = 0").select(F.col("id") + 100000, F.concat("text", F.lit(" Again.")))
    return b.union(again).union(b.where("id % 5 = 0").select(F.col("id") + 200000, F.substring("text", 1, 70)))


@query("copies_pairs", COPY + "SELECT a, b FROM l")
def copies_pairs(spark, sf_dir):
    return copy_pairs(_copied(spark, sf_dir), "id", "text")


@query("copies_components", COPY + """, RECURSIVE_EDGES AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), c0 AS (SELECT a AS node, least(a, min(b)) AS root FROM RECURSIVE_EDGES GROUP BY a),
c1 AS (SELECT e.a AS node, least(min(c.root), min(d.root)) AS root FROM RECURSIVE_EDGES e JOIN c0 c ON e.a = c.node JOIN c0 d ON e.b = d.node GROUP BY e.a),
c2 AS (SELECT e.a AS node, least(min(c.root), min(d.root)) AS root FROM RECURSIVE_EDGES e JOIN c1 c ON e.a = c.node JOIN c1 d ON e.b = d.node GROUP BY e.a) SELECT node, root FROM c2""")
def copies_components(spark, sf_dir):
    return connected_components(copy_pairs(_copied(spark, sf_dir), "id", "text"))


@query("name_match", "SELECT p_name, count(*) AS n FROM (SELECT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS p_name FROM part) GROUP BY 1 HAVING count(*) > 1")
def name_match(spark, sf_dir):
    """Names that are equal after normalising."""
    return table(spark, sf_dir, "part").groupBy(x.normal_exact("p_name").alias("p_name")).agg(F.count("*").alias("n")).where("n > 1")


@query("topic_subset", f"SELECT b.item_id, count(*) AS n FROM (SELECT item_id, {TERMS} AS t FROM benchmark) b JOIN (SELECT {TERMS} AS t FROM documents) d ON list_has_all(d.t, b.t) GROUP BY 1")
def topic_subset(spark, sf_dir):
    """Documents that have all terms of an item: found by the item's rarest term, and then compared. Texts are read once,
    and only their terms that items have are kept. A document's terms are moved once for all items, not for each of its terms."""
    texts = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select("item_id", x.terms("text").alias("q")).groupBy("item_id", "q").agg(F.count("*").alias("rows"))
    asked = items.select(F.explode("q").alias("term")).distinct()
    terms = texts.select(F.monotonically_increasing_id().alias("row"), "text").select("row", F.explode(x.terms("text")).alias("term"))
    docs = store(terms.join(asked, "term").groupBy("row").agg(F.collect_set("term").alias("t")), "topic-terms")
    held = docs.select("row", F.explode("t").alias("term"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rare = items.select("item_id", "q", "rows", F.explode("q").alias("term")).join(df, "term", "left").groupBy("item_id", "q", "rows").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    found = held.join(rare, "term").drop("term").join(docs, "row").where(F.size(F.array_except("q", "t")) == 0).select("item_id", "rows")
    n = found.groupBy("item_id").agg(F.sum("rows").alias("n"))
    bare = items.where(F.size("q") == 0).select("item_id", "rows")
    if bare.isEmpty():
        return n
    # An item without terms is held by every document that has a text.
    every = texts.agg(F.count("text").alias("every")).where("every > 0")
    return n.unionByName(bare.crossJoin(every).select("item_id", (F.col("rows") * F.col("every")).alias("n"))).groupBy("item_id").agg(F.sum("n").alias("n"))


@query("reply_tree", """WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations), t AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, depth FROM t""")
def reply_tree(spark, sf_dir):
    """Turns as a reply tree: each answers the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("%d:%d", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.format_string("%d:%d", "conv_id", F.col("turn") - 1)).alias("parent")).distinct()
    d = depths(c, "id", "parent")
    return c.join(d, "id").select("conv_id", "turn", F.col("depth").cast("long").alias("depth"))


@query("name_resolution")
def name_resolution(spark, sf_dir):
    """Part names against all part names."""
    from tidemark.operators.names import resolve

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return resolve(p, p)


@query("leader_clusters")
def leader_clusters(spark, sf_dir):
    """Documents as hourly posts of their language, clustered by their informative terms."""
    from tidemark.operators.clusters import leader_clusters as run

    d = table(spark, sf_dir, "documents")
    terms = F.filter(x.content_terms("text"), lambda t: x.informative(t))
    return run(d.select(F.col("lang").alias("topic"), F.col("doc_id").alias("post_id"), (F.col("doc_id") * 3600.0).alias("published"), terms.alias("terms")))


def _listed(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


LINKLESS = r"array_to_string(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+'), lambda w: w <> '' AND NOT (contains(w, '://') OR starts_with(w, 'www.') OR starts_with(w, '@') OR regexp_matches(w, '^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,6}[,)\]」、。]*(/.*)?$'))), ' ')"
GRAMS = f"""WITH l AS (SELECT doc_id, lang, source, {LINKLESS} AS t FROM documents),
w AS (SELECT doc_id, lang, source, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT *, regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}''-]') AS w FROM l)),
o AS (SELECT *, length(w) > 1 AND w NOT IN {_listed(stopwords.BREAKS)} AS ok FROM w),
n AS (SELECT doc_id, lang, source, CASE WHEN ok AND lead(ok) OVER x THEN w || ' ' || lead(w) OVER x END AS p2, CASE WHEN ok AND lead(ok) OVER x AND lead(ok, 2) OVER x THEN w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x END AS p3,
  CASE WHEN ok AND lead(ok) OVER x AND lead(ok, 2) OVER x AND lead(ok, 3) OVER x THEN w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x || ' ' || lead(w, 3) OVER x END AS p4 FROM o WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, lang, source, phrase FROM (SELECT doc_id, lang, source, unnest([p2, p3, p4]) AS phrase FROM n) WHERE phrase IS NOT NULL),
h AS (SELECT lang, phrase, count(*) AS posts, count(DISTINCT source) AS authors FROM g GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT source) >= 2),
s AS (SELECT lang, posts, regexp_replace(phrase, '^[^ ]+ ', '') AS part FROM h UNION SELECT lang, posts, regexp_replace(phrase, ' [^ ]+$', '') FROM h),
m AS (SELECT lang, phrase, posts, authors FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = h.lang AND s.posts = h.posts AND s.part = h.phrase)) """


def _phrases(spark, sf_dir):
    return phrases.shared_phrases(table(spark, sf_dir, "documents"), "lang", "source", "text", longest=4)


@query("maximal_phrases", GRAMS + "SELECT lang, phrase, posts, authors FROM m")
def maximal_phrases(spark, sf_dir):
    """A document as a post, its source as the author, its language as the group."""
    return _phrases(spark, sf_dir).select("lang", "phrase", "posts", "authors")


@query("candidate_phrases", GRAMS + "SELECT lang, phrase, posts, k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY posts DESC, len(string_split(phrase, ' ')) DESC, encode(phrase)) AS k FROM m) WHERE k <= 5")
def candidate_phrases(spark, sf_dir):
    return phrases.candidate_phrases(_phrases(spark, sf_dir), "lang").select("lang", "phrase", "posts", "k")


@query(
    "salient_terms",
    f"""WITH t AS (SELECT lang, unnest(list_distinct(list_filter(regexp_extract_all(lower({LINKLESS}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2))) AS term FROM documents),
n AS (SELECT lang, term, count(*) AS posts FROM t WHERE term NOT IN {_listed((*x.STOP, *stopwords.EVERY))} AND NOT regexp_matches(term, '^[0-9]+$') AND NOT regexp_matches(term, '^[0-9]+x[0-9]+$') AND NOT (strlen(term) >= 6 AND regexp_matches(term, '^[0-9A-Fa-f]+$') AND regexp_matches(term, '[0-9]')) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT lang, term, posts, k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY posts DESC, encode(term)) AS k FROM n) WHERE k <= 20""",
)
def salient_terms(spark, sf_dir):
    return phrases.salient_terms(table(spark, sf_dir, "documents"), "lang", "text")
