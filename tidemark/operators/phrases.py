"""Phrases and terms that several posts of a group share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import bracketed_spans, content_terms, informative, phrase_grams
from tidemark.storage import store


def shared_phrases(posts: DataFrame, group: str, author: str, text: str, longest: int = 3, least_posts: int = 2, least_authors: int = 2) -> DataFrame:
    """(group, phrase, posts, authors, bracketed): phrases of several posts by several authors that aren't merely a part of
    a longer one.

    A phrase is a run of up to `longest` words (phrase_grams) or a bracketed span. One that stands within a longer phrase
    with as many posts never occurs without it and is left out. posts has a row for each post; an author that is null is
    an author of its own for all such posts. Counts are added up by author first, so a phrase that one author repeats is one
    row in the shuffle of each task; a longer phrase meets its parts by a join on the part.
    """
    runs, spans = phrase_grams(text, longest), bracketed_spans(text)
    each = posts.select(F.col(group).alias("g"), F.col(author).alias("a"), spans.alias("s"), F.array_union(runs, spans).alias("p"))
    # explode_outer, as for explode Spark infers a filter on p, which would make it twice.
    each = each.select("g", "a", F.explode_outer("p").alias("phrase"), "s").where("phrase IS NOT NULL").select("g", "a", "phrase", F.array_contains("s", F.col("phrase")).alias("b"))
    by_author = each.groupBy("g", "phrase", "a").agg(F.count("*").alias("n"), F.bool_or("b").alias("b"))
    held = by_author.groupBy("g", "phrase").agg(F.sum("n").alias("posts"), F.count("*").alias("authors"), F.bool_or("b").alias("bracketed"))
    # Written, as both sides of the join below are made of it and would else count all posts' phrases again.
    held = store(held.where((F.col("posts") >= least_posts) & (F.col("authors") >= least_authors)), "phrases")
    words = F.split("phrase", " ")
    n = F.size(words)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))
    within = held.select("g", "posts", F.explode(F.array_distinct(F.array_except(parts, F.array("phrase")))).alias("phrase"))
    maximal = held.join(within, ["g", "phrase", "posts"], "left_anti")
    return maximal.select(F.col("g").alias(group), "phrase", "posts", "authors", "bracketed")


def candidate_phrases(shared: DataFrame, group: str, most: int = 5) -> DataFrame:
    """shared_phrases with k, their rank in the group by posts, words and text; the first `most`."""
    order = Window.partitionBy(group).orderBy(F.desc("posts"), F.desc(F.size(F.split("phrase", " "))), "phrase")
    return shared.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)


def salient_terms(posts: DataFrame, group: str, text: str, most: int = 20, least_posts: int = 2) -> DataFrame:
    """(group, term, posts, k): the informative content terms that most posts of a group have. posts has a row for each post."""
    each = posts.select(F.col(group).alias("g"), F.explode(content_terms(text)).alias("term"))
    n = each.groupBy("g", "term").agg(F.count("*").alias("posts")).where((F.col("posts") >= least_posts) & informative("term"))
    k = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("posts"), "term"))
    return n.withColumn("k", k).where(F.col("k") <= most).select(F.col("g").alias(group), "term", "posts", "k")
