"""Incremental index over a landing folder of pages, and the host state machine as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import index
from ..operators.frontier import RESETTING

PAGES = "doc_id bigint, url string, title string, content string, content_hash string, last_crawled timestamp"


def landing(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def index_stream(pages: DataFrame, out: str, checkpoint: str):
    """Each micro-batch writes the postings of its newest page versions below ``out``, partitioned by batch.

    A batch that is run again overwrites its own partition only, so the sink is idempotent.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max_by(F.struct("title", "content", "content_hash", "last_crawled"), "last_crawled").alias("p")).select("doc_id", "p.title", "p.content", "p.content_hash", "p.last_crawled")
        rows = index.postings(newest).join(newest.select("doc_id", "last_crawled"), "doc_id")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(spark: SparkSession, out: str) -> DataFrame:
    """Postings of the newest version of every document over all batches."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("last_crawled", "batch")).alias("m")).select("doc_id", F.col("m.batch").alias("batch"))
    return rows.join(newest, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "tf")


def host_machine(events: DataFrame) -> DataFrame:
    """(host, status, failures) after each micro-batch of (host, at, status) events, with the count kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, failures = state.get if state.exists else ("", 0)
        for b in batches:
            for s in b.sort_values("at").status:
                status, failures = s, (0 if s in RESETTING else failures + 1)
        state.update((status, failures))
        yield pd.DataFrame({"host": [key[0]], "status": [status], "failures": [failures]})

    return events.groupBy("host").applyInPandasWithState(step, "host string, status string, failures int", "status string, failures int", "update", GroupStateTimeout.NoTimeout)
