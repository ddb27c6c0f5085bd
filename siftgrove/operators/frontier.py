"""Crawl frontier as tables: queue merge, due and retry scans, admission of links, robots rules, host states, BFS."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from ..functions import urls

# Host states that keep a host from being queued again, and those that reset its failures.
SETTLED = ("seed", "queued", "crawled", "failed", "blocked")
RESETTING = ("queued", "crawled", "seed", "pending")


def merge_queue(queue: DataFrame) -> DataFrame:
    """One row per url: least depth, highest priority, the newest host that is known, first and last times."""
    return queue.groupBy("url").agg(
        F.min("depth").alias("depth"),
        F.max("priority").alias("priority"),
        F.max_by("host", F.when(F.col("host").isNotNull(), F.struct("added_at", "host"))).alias("host"),
        F.min("added_at").alias("added_at"),
        F.max("last_attempt").alias("last_attempt"),
    )


def next_urls(queue: DataFrame, limit: int) -> DataFrame:
    return merge_queue(queue).orderBy(F.desc("priority"), "added_at", "url").limit(limit).select("url", "depth", "priority")


def per_host(queue: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` urls of each host, by priority; hot hosts are cut in every task before the shuffle."""
    rows = merge_queue(queue).select("url", F.coalesce("host", urls.host(F.col("url"))).alias("host"), "priority", "added_at")
    order = Window.partitionBy("host").orderBy(F.desc("priority"), "added_at", "url")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= cap).select("host", "url", "at")


def due(documents: DataFrame, as_of: datetime, limit: int | None = None) -> DataFrame:
    """(doc_id, url, due_at): documents to visit again; no date means due, and sorts by the last visit."""
    rows = documents.filter(F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= F.lit(as_of))).select("doc_id", "url", F.coalesce("next_crawl_at", "last_crawled").alias("due_at"))
    return rows.orderBy(F.asc_nulls_first("due_at"), "doc_id").limit(limit) if limit else rows


def next_due(documents: DataFrame, as_of: datetime) -> DataFrame:
    return documents.filter(F.col("next_crawl_at") > F.lit(as_of)).agg(F.min("next_crawl_at").alias("next_due"))


def to_retry(hosts: DataFrame, as_of: datetime, limit: int | None = None) -> DataFrame:
    """(host, status, failure_count, since): hosts to try again, the longest waiting first where a limit is given."""
    rows = hosts.filter(F.col("status").isin("failed", "blocked") & (F.col("retry_after").isNull() | (F.col("retry_after") <= F.lit(as_of))))
    out = rows.select("host", "status", "failure_count", F.coalesce("retry_after", "first_seen").alias("since"))
    return out.orderBy(F.asc_nulls_first("since"), "host").limit(limit) if limit else out


def robots_allowed(paths: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``allowed``: the longest rule that is a prefix of the path wins, then the first; no rule allows.

    paths: (host, path); rules: (host, ord, pattern, allow). An empty Disallow allows all, unless ``strict`` keeps
    the behaviour of blocking. The join is by host, the prefix test is its residual.
    """
    r = rules if strict else rules.filter("pattern <> '' or allow")
    j = paths.join(r.withColumnRenamed("host", "rule_host"), (F.col("host") == F.col("rule_host")) & F.col("path").startswith(F.col("pattern")), "left")
    best = F.max_by("allow", F.struct(F.length("pattern"), -F.col("ord")))
    return j.groupBy("host", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


def admission(links: DataFrame, hosts: DataFrame, quota: int) -> DataFrame:
    """(origin, url, verdict) for (origin, url) links: 'queue' inside the origin's site, else by host state and quota.

    Links that are no http(s) address are 'skip'. New hosts are admitted up to ``quota`` per origin, in url order;
    a negative quota is no limit.
    """
    known = hosts.filter(F.col("status").isin(*SETTLED)).select(F.lower("host").alias("target"), F.lit(True).alias("settled"))
    l = links.distinct().withColumn("target", urls.host(F.col("url"))).withColumn("good", F.lower("url").rlike(r"^https?://") & (F.col("target") != ""))
    j = l.join(known, "target", "left")
    inside = F.col("good") & (F.col("target") == F.col("origin"))
    new = F.col("good") & ~inside & F.col("settled").isNull()
    marked = j.select("origin", "url", "target", F.when(~F.col("good"), "skip").when(inside, "queue").when(F.col("settled"), "known").otherwise("over quota" if quota >= 0 else "discover").alias("verdict"), new.alias("new"))
    if quota < 0:
        return marked.select("origin", "url", "verdict")
    # the quota is cut in every task before the shuffle, so a hot origin's links are never sorted in one
    nth = F.row_number().over(Window.partitionBy("origin").orderBy("target", "url"))
    first = marked.filter("new").withColumn("nth", nth).filter(F.col("nth") <= quota).select("origin", "url", F.lit("discover").alias("taken"))
    return marked.join(first, ["origin", "url"], "left").select("origin", "url", F.coalesce("taken", "verdict").alias("verdict"))


def host_states(events: DataFrame) -> DataFrame:
    """(host, status, failures) after all (host, at, status) events: failures since the last resetting state."""
    reset = F.max(F.when(F.col("status").isin(*RESETTING), F.col("at"))).over(Window.partitionBy("host"))
    e = events.withColumn("reset_at", reset)
    failed = F.col("status").isin("failed", "blocked") & (F.col("reset_at").isNull() | (F.col("at") > F.col("reset_at")))
    return e.groupBy("host").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.count_if(failed).alias("failures"))


def crawl(seeds: DataFrame, fetch_links: Callable[[DataFrame], DataFrame], max_depth: int) -> DataFrame:
    """(url, depth): breadth-first visit; each level is one distributed fetch, visited urls are left out by anti-join."""
    visited = stored(seeds.select(urls.canonical(urls.with_scheme(F.col("url"))).alias("url"), F.lit(0).alias("depth")).distinct(), "frontier")
    level = visited
    for depth in range(1, max_depth + 1):
        found = fetch_links(level).select(urls.canonical(F.col("url")).alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        level = stored(found.withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def next_visit(doc_id: Column, as_of: datetime, hours: float, spread: float = 0.15, seed: int = 7) -> Column:
    """Time of the next visit: ``hours`` stretched by up to ``spread`` to both sides (seeded by the id), a quarter of an hour at least."""
    jitter = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(2_000_001)) / 1_000_000 - 1) * spread
    return F.when(F.lit(hours > 0), F.timestamp_seconds(F.lit(as_of.timestamp()) + F.greatest(F.lit(0.25), hours * (1 + jitter)) * 3600))


def waits(queue: DataFrame, delays: DataFrame, delay: float, as_of: datetime) -> DataFrame:
    """(host, wait_seconds): the host's delay (its own, if longer) less the time since its last attempt, never below 0."""
    last = queue.select(F.coalesce("host", urls.host(F.col("url"))).alias("host"), "last_attempt").groupBy("host").agg(F.max("last_attempt").alias("last"))
    gone = F.lit(as_of.timestamp()) - F.unix_micros("last") / 1e6
    needed = F.greatest(F.lit(float(delay)), F.coalesce("crawl_delay", F.lit(0.0)))
    return last.join(delays, "host", "left").select("host", F.when(F.col("last").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), needed - gone), 3)).alias("wait_seconds"))


def crawl_order(queue: DataFrame, limit: int) -> DataFrame:
    """(url, at): Turkish addresses to the front (the latest first, as they are pushed there), the others as they came."""
    rows = merge_queue(queue).select("url", "added_at", urls.is_turkish(F.col("url")).alias("front"))
    age = F.when(F.col("front"), -F.unix_micros("added_at")).otherwise(F.unix_micros("added_at"))
    best = rows.select("url", "front", age.alias("age")).orderBy(F.desc("front"), "age", "url").limit(limit)
    return best.select("url", F.row_number().over(Window.orderBy(F.desc("front"), "age", "url")).alias("at"))  # over ``limit`` rows


def retry_at(as_of: datetime, hours: float, jitter: Column | float = 0.0) -> Column:
    """``as_of`` plus at least 0.1 hours, stretched by a share ``jitter``; null for no retry."""
    return F.when(F.lit(hours > 0), F.timestamp_seconds(F.lit(as_of.timestamp()) + F.greatest(F.lit(0.1), hours * (1 + F.lit(jitter) if isinstance(jitter, float) else 1 + jitter)) * 3600))
