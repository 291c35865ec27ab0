"""Order-dependent and greedy operators."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import new_folder, store

#: Shared terms, their share of all, and seconds from a group's first post.
SHARED, SHARE, SPAN = 3, 0.15, 604_800
#: Posts of a topic, and about how many terms of theirs, that are judged one after another in a task.
BLOCK, TERMS = 32_768, 3_000_000

_JUDGED = "topic string, post_id long, leader long, begun double, fresh array<string>"
_ARROW = pa.schema([("topic", pa.string()), ("post_id", pa.int64()), ("leader", pa.int64()), ("begun", pa.float64()), ("fresh", pa.list_(pa.string()))])


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of a column of lists one after another, and where each row's begin and the last one's end."""
    x = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    return x.flatten(), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def judge(posts: pa.Table, groups: pa.Table | None = None, shared: int = SHARED, share: float = SHARE, overlap: bool = False) -> pa.Table:
    """A block of a topic's posts (topic, post_id, published, terms), judged in order: each joins the first group that fits.

    groups (leader, begun, size, terms) are those of earlier blocks that may fit, with such of their terms as the block may
    have too. Terms are numbers here, and of each span of time there is an index from terms to the groups begun in it, which
    lasts until no post to come is near enough. fresh are the terms that a post brings to its group.
    """
    posts = posts.sort_by("post_id")
    flat, ends = _lists(posts["terms"])
    flat = flat.dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    ids, at = posts["post_id"].to_numpy(), posts["published"].to_numpy()
    spans = np.floor_divide(at, SPAN)
    soonest, latest = (f.accumulate(spans[::-1])[::-1] for f in (np.fmin, np.fmax))
    old = 0 if groups is None else groups.num_rows
    leader, begun, size = np.empty(old + len(ids), np.int64), np.empty(old + len(ids)), np.zeros(old + len(ids), np.int64)
    index: dict[float, dict[int, array]] = {}
    # How often the block and the groups have a term; one that is had once is common to none.
    times = np.bincount(codes, minlength=len(flat.dictionary) + 1)
    if old:
        groups = groups.sort_by("leader")
        of, till = _lists(groups["terms"])
        of = pc.fill_null(pc.index_in(of, value_set=flat.dictionary), len(flat.dictionary)).to_numpy(zero_copy_only=False)
        leader[:old], begun[:old], size[:old] = (groups[c].to_numpy() for c in ("leader", "begun", "size"))
        times += np.bincount(of, minlength=len(times))
        times[-1] = 0

    def add(g: int, terms: np.ndarray) -> None:
        if begun[g] == begun[g]:
            held = index.setdefault(begun[g] // SPAN, {})
            for x in terms[times[terms] > 1].tolist():
                if x in held:
                    held[x].append(g)
                else:
                    held[x] = array("i", (g,))

    for g in range(old):
        add(g, of[till[g] : till[g + 1]])
    count, joined, fresh = old, np.empty(len(ids), np.int64), []
    for i in range(len(ids)):
        own, time, hit = codes[ends[i] : ends[i + 1]], at[i], -1
        new = own
        if i and spans[i] != spans[i - 1]:
            for s in [s for s in index if not soonest[i] - 1 <= s <= latest[i] + 1]:
                del index[s]
        if time == time:
            terms, met = own[times[own] > 1].tolist(), array("i")
            for s in (spans[i] - 1, spans[i], spans[i] + 1):
                if held := index.get(s):
                    for found in filter(None, map(held.get, terms)):
                        met.extend(found)
            if met:
                with_term = np.frombuffer(met, np.int32)
                first = with_term.min()
                both = np.bincount(with_term - first)
                near = np.flatnonzero(both >= max(1, shared))
                both, near = both[near], near + first
                whole = np.minimum(len(own), size[near]) if overlap else len(own) + size[near] - both
                fits = near[(both >= share * whole) & (np.abs(time - begun[near]) <= SPAN)]
                if len(fits):
                    hit = int(fits[0])
                    held = index[begun[hit] // SPAN]
                    had = [(x, np.frombuffer(held[x], np.int32)) for x in terms if x in held]
                    new = np.setdiff1d(own, np.array([x for x, found in had if (found == hit).any()], codes.dtype))
                    del had
        if hit < 0:
            hit, count = count, count + 1
            leader[hit], begun[hit] = ids[i], time
        size[hit] += len(new)
        add(hit, new)
        joined[i] = hit
        fresh.append(new)
    brought = flat.dictionary.take(pa.array(np.concatenate([*fresh, np.empty(0, codes.dtype)])))
    cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in fresh])]).astype(np.int32))
    return pa.table([posts["topic"], posts["post_id"], leader[joined], pa.array(begun[joined], from_pandas=True), pa.ListArray.from_arrays(cut, brought)], schema=_ARROW)


def lead(rows: pd.DataFrame, **rule) -> pd.DataFrame:
    """judge() of a topic's first block, as pandas has it."""
    return judge(pa.Table.from_pandas(rows, pa.schema([("topic", pa.string()), ("post_id", pa.int64()), ("published", pa.float64()), ("terms", pa.list_(pa.string()))]), preserve_index=False), **rule).to_pandas()


def leader_clusters(posts: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """(topic, post_id, leader) of posts (topic, post_id, published, terms), by topic in order of post_id, a number of its own
    for each post of a topic. rule: shared, share and overlap (of the smaller set instead of the union).

    The result is that of one pass over each topic, in which a post joins the first group with enough terms in common and
    begun near enough, and groups take over their posts' terms. It is had in rounds of about `block` posts of each topic,
    fewer if these have more than TERMS terms: one task for each topic judges a round in order, given the groups of the
    rounds before that began near enough to the round's posts. Where these have more than TERMS terms, only those go to
    the task that the round's posts have too. Rounds whose groups all began too far from these are not read. So a task holds a block and what it has in common with groups,
    never a topic. A post without a time, or without terms, is a group of its own.
    """
    spark = posts.sparkSession
    # A mark in front, so that a topic without a name joins like the others.
    topic = F.when(F.col("topic").isNull(), "").otherwise(F.concat(F.lit("="), F.col("topic").cast("string")))
    time = F.col("published").cast("double")
    p = posts.select(topic.alias("topic"), F.col("post_id").cast("long").alias("post_id"), F.when(F.abs(time) < float("inf"), time).alias("published"), F.array_distinct(F.array_compact("terms")).alias("terms"))
    p = store(p, "posts")
    counts = p.groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.size("terms"))).alias("terms"))
    most = counts.agg(F.max("n"), F.max("terms")).first()
    rounds = max(1, -(-(most[0] or 0) // block), -(-(most[1] or 0) // TERMS))
    if rounds > 1:
        # The same shares of each topic too large for one block, of which there are at most as many as blocks; how many posts a
        # block gets exactly makes no difference to the result.
        large = counts.where((F.col("n") > block) | (F.col("terms") > TERMS)).select("topic")
        cuts = p.join(F.broadcast(large), "topic", "left_semi").groupBy(F.col("topic").alias("of")).agg(F.percentile_approx("post_id", [i / rounds for i in range(1, rounds)], 100 * rounds).alias("cuts"))
        cut = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("post_id"))), F.lit(0))
        p = p.join(F.broadcast(cuts), F.col("topic") == F.col("of"), "left").select("topic", "post_id", "published", "terms", F.greatest(cut, F.lit(0)).alias("block"))
        p = p.repartition("block", "topic")
    else:
        p = p.withColumn("block", F.lit(0))
    folder = new_folder(spark, "clusters")
    p.write.partitionBy("block").parquet(f"{folder}/posts")
    kept = spark.read.schema(p.schema).parquet(f"{folder}/posts")
    # When a round's posts were published; the groups that they join began within a span of that.
    when = {r["block"]: (r["lo"], r["hi"]) for r in kept.groupBy("block").agg(F.min("published").alias("lo"), F.max("published").alias("hi")).where("lo IS NOT NULL").collect()}
    done: list[str] = []
    for k in range(rounds):
        now = kept.where(F.col("block") == k).drop("block")
        lo, hi = when.get(k, (0.0, 0.0))
        reach = 2 * SPAN  # more than enough, whatever rounding does
        before = [f"{folder}/judged-{j}" for j in range(k) if k in when and j in when and when[j][0] - reach <= hi + reach and when[j][1] + reach >= lo - reach]
        if before:
            held = spark.read.schema(_JUDGED).parquet(*before).where(F.col("begun").between(lo - reach, hi + reach))
            if (held.agg(F.sum(F.size("fresh"))).first()[0] or 0) <= TERMS:
                terms, size = F.flatten(F.collect_list("fresh")), F.sum(F.size("fresh"))
            else:
                asked = now.select(F.col("topic").alias("of"), F.explode("terms").alias("asked")).distinct()
                held = held.select("topic", "leader", "begun", F.explode("fresh").alias("term"))
                held = held.join(asked, (F.col("topic") == F.col("of")) & (F.col("term") == F.col("asked")), "left")
                terms, size = F.collect_list("asked"), F.count("term")
            groups = held.groupBy("topic", "leader").agg(F.max("begun").alias("begun"), size.alias("size"), terms.alias("terms")).where(F.size("terms") > 0)
            both = now.groupBy("topic").cogroup(groups.groupBy("topic"))
            judged = both.applyInArrow(lambda p, g: judge(p, g, **rule), _JUDGED)
        else:
            judged = now.groupBy("topic").applyInArrow(lambda p: judge(p, **rule), _JUDGED)
        judged.write.parquet(f"{folder}/judged-{k}")
        done.append(f"{folder}/judged-{k}")
    named = F.when(F.col("topic") != "", F.substring("topic", 2, 1 << 30))
    return spark.read.schema(_JUDGED).parquet(*done).select(named.alias("topic"), "post_id", "leader")


def choose(rows: pd.DataFrame, requests: int, money: int) -> pd.DataFrame:
    """Actions by score, as long as both budgets hold and their gap is still open."""
    cost = 1.0 * rows["requests"] + rows["latency_ms"] / 1000 + rows["redundancy"] + rows["cost"]
    ordered = rows.assign(score=rows["points"] / cost.clip(lower=1e-9)).sort_values(["score", "url", "action"], ascending=[False, True, True])
    out, gaps, used, spent = [], set(), 0, 0
    for r in ordered.itertuples():
        if r.gap in gaps or used + r.requests > requests or spent + r.cost > money:
            continue
        gaps.add(r.gap)
        used, spent = used + r.requests, spent + r.cost
        out.append((r.plan, r.action, len(out) + 1))
    return pd.DataFrame(out, columns=["plan", "action", "k"])


def budgeted_actions(actions: DataFrame, requests: int, money: int) -> DataFrame:
    """(plan, action, k): greedy choice per plan of actions (plan, action, url, gap, points, requests, latency_ms, redundancy, cost)."""
    return actions.groupBy("plan").applyInPandas(lambda g: choose(g, requests, money), "plan string, action string, k int")
