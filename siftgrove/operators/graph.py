"""Link graph and PageRank with sink mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import dropped, stored
from ..config import GraphConfig
from ..functions import urls


def host_links(discovered_hosts: DataFrame) -> DataFrame:
    """(src, dst): the site a host was found on, and the host."""
    edges = discovered_hosts.select(urls.host(F.col("source_url")).alias("src"), F.lower("host").alias("dst"))
    return edges.filter("src <> '' and dst <> ''")


def page_links(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """(src, dst): links of parsed pages that lead to known documents, by canonical address."""
    targets = documents.select(F.col("doc_id").alias("dst"), urls.canonical(F.col("url")).alias("target"))
    links = parsed.filter("doc_id is not null").select(F.col("doc_id").alias("src"), F.explode("links").alias("link")).select("src", urls.canonical(F.col("link")).alias("target"))
    return links.join(targets, "target").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) over all end points; repeated edges count."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, config: GraphConfig = GraphConfig(), iterations: int | None = None) -> DataFrame:
    """(node, rank), ranks scaled to mean 1. A fixed number of iterations, or until the L1 change is below epsilon.

    Ranks are written to the shared folder each iteration, which cuts the lineage and survives lost executors.
    """
    d = config.damping
    nodes = stored(degrees(edges).select("node", "out_degree"), "nodes")
    # repeated edges are one row with a count, which also cuts what a hub sends
    weighted = stored(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")), "edges")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "out_degree", F.lit(1.0 / n).alias("rank"))
    before = None
    for _ in range(iterations or config.max_iterations):
        sink = ranks.filter("out_degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("sink"))
        share = ranks.filter("out_degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share"))
        came = weighted.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("times")).alias("came"))
        joined = ranks.withColumnRenamed("rank", "old").join(came, "node", "left").crossJoin(F.broadcast(sink))  # one row
        new = joined.select("node", "out_degree", ((1 - d) / n + d * (F.coalesce("came", F.lit(0.0)) + F.col("sink") / n)).alias("rank"), "old")
        new = stored(new, "ranks")
        done = iterations is None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0] < config.epsilon
        if before is not None:
            dropped(before)
        ranks, before = new.drop("old"), new
        if done:
            break
    return ranks.select("node", F.round(F.col("rank") * n, 6).alias("rank"))
