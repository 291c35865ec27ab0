"""Social documents to posts of one shape: JSON in, typed rows out, unknown counters null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POST = ["platform", "native_id", "author", "text", "url", "published", "likes", "replies", "reposts", "parent", "tags"]

_HN = "struct<hits:array<struct<objectID:string,author:string,title:string,comment_text:string,url:string,created_at_i:bigint,points:bigint,num_comments:bigint,parent_id:bigint>>>"
_BSKY = "struct<posts:array<struct<uri:string,author:struct<handle:string>,record:struct<text:string,createdAt:string>,likeCount:bigint,replyCount:bigint,repostCount:bigint>>>"
_MASTODON = "array<struct<id:string,account:struct<acct:string>,content:string,url:string,created_at:string,favourites_count:bigint,replies_count:bigint,reblogs_count:bigint,in_reply_to_id:string,tags:array<struct<name:string>>>>"
_TAG_DAYS = "struct<name:string,history:array<struct<day:string,uses:string,accounts:string>>>"


def plain(html: Column) -> Column:
    """Post text without tags: paragraphs and breaks are lines, the five entities are characters."""
    x = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>|</p>\s*<p>", "\n"), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def _seconds(iso: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(iso))


def posts(captures: DataFrame, body: str = "body", platform: str = "platform") -> DataFrame:
    """Posts of captured JSON documents of three platforms; documents that don't parse give none."""
    null = F.lit(None)
    hn = captures.where(F.col(platform) == "hackernews").select(F.explode(F.from_json(body, _HN)["hits"]).alias("p"))
    hn = hn.select(F.lit("hackernews"), "p.objectID", "p.author", plain(F.coalesce("p.comment_text", "p.title")), "p.url", "p.created_at_i", "p.points", "p.num_comments", null.cast("long"), F.col("p.parent_id").cast("string"), F.array().cast("array<string>"))
    sky = captures.where(F.col(platform) == "bluesky").select(F.explode(F.from_json(body, _BSKY)["posts"]).alias("p"))
    sky = sky.select(F.lit("bluesky"), "p.uri", "p.author.handle", "p.record.text", null.cast("string"), _seconds(F.col("p.record.createdAt")), "p.likeCount", "p.replyCount", "p.repostCount", null.cast("string"), F.regexp_extract_all("p.record.text", F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)))
    toot = captures.where(F.col(platform) == "mastodon").select(F.explode(F.from_json(body, _MASTODON)).alias("p"))
    toot = toot.select(F.lit("mastodon"), "p.id", "p.account.acct", plain(F.col("p.content")), "p.url", _seconds(F.col("p.created_at")), "p.favourites_count", "p.replies_count", "p.reblogs_count", "p.in_reply_to_id", F.transform("p.tags", lambda t: t["name"]))
    return hn.toDF(*POST).unionByName(sky.toDF(*POST)).unionByName(toot.toDF(*POST))


def tag_usage(captures: DataFrame, captured: Column, body: str = "body") -> DataFrame:
    """(tag, day, uses, accounts, complete): a day that isn't over at the capture is open."""
    t = F.from_json(body, _TAG_DAYS)
    rows = captures.select(t["name"].alias("tag"), captured.alias("at"), F.explode(t["history"]).alias("h"))
    day = F.col("h.day").try_cast("long")
    return rows.select("tag", day.alias("day"), F.col("h.uses").try_cast("long").alias("uses"), F.col("h.accounts").try_cast("long").alias("accounts"), (day + 86400 <= F.col("at")).alias("complete"))
