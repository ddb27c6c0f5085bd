"""Versioned corpus: snapshots, current versions, overlapping chunks, stale embeddings, deletes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import text


def chunk_starts(n: Column, config: ChunkConfig) -> Column:
    """First word (from 0) of each chunk: steps of ``max - overlap`` until a chunk reaches the end."""
    m, step = config.max_tokens, max(1, config.max_tokens - max(0, config.overlap))
    all_ = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= m, F.array(F.lit(0))).otherwise(F.filter(all_, lambda s: (s == 0) | (s - step + m < n)))


def chunks(documents: DataFrame, config: ChunkConfig = ChunkConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_index, content, token_count, content_hash, quality_score, *keep): overlapping word windows."""
    parts = documents.select("doc_id", *keep, text.words(F.col("content")).alias("w"), text.quality_score(F.col("title"), F.col("content")).alias("quality_score"))
    at = parts.select("doc_id", *keep, "w", "quality_score", F.posexplode_outer(chunk_starts(F.size("w"), config)).alias("chunk_index", "s")).filter("s is not null")
    cut = at.select("doc_id", *keep, "chunk_index", F.array_join(F.slice("w", F.col("s") + 1, config.max_tokens), " ").alias("content"), "quality_score")
    return cut.select("doc_id", "chunk_index", "content", F.size(text.tokens_all(F.col("content"))).alias("token_count"), text.sha(F.col("content")).alias("content_hash"), "quality_score", *keep)


def versions(snapshots: DataFrame) -> DataFrame:
    """One row per (doc_id, content_hash): version by first sight, first and last sight, whether it is current.

    The last seen hash is current, also after a return to an older one. Rows without doc_id take no part.
    """
    seen = snapshots.filter("doc_id is not null and content_hash is not null")
    per = seen.groupBy("doc_id", "content_hash").agg(F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
    by_doc = Window.partitionBy("doc_id")
    return per.withColumn("version", F.row_number().over(by_doc.orderBy(F.asc_nulls_first("first_seen"), "content_hash"))).withColumn("is_current", F.row_number().over(by_doc.orderBy(F.desc_nulls_last("last_seen"), F.desc("version"))) == 1)


def current(snapshots: DataFrame) -> DataFrame:
    return versions(snapshots).filter("is_current")


def without_repeats(snapshots: DataFrame) -> DataFrame:
    """One row per (url, content_hash), the lowest snapshot id: the unique key of the snapshot store."""
    keep = Window.partitionBy("url", "content_hash").orderBy("snapshot_id")
    return snapshots.withColumn("at", F.row_number().over(keep)).filter("at = 1").drop("at")


def next_version(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.max("document_version"), F.lit(0)) + 1).alias("next_version"))


def backfill(documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Documents without a current snapshot."""
    return documents.join(snapshots.filter("is_current").select("doc_id"), "doc_id", "left_anti")


def stale_embeddings(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(doc_id, state): documents whose embedding is missing, or was made from other content."""
    j = documents.select("doc_id", "content_hash").join(embeddings.select("doc_id", "source_hash", F.lit(True).alias("has")), "doc_id", "left")
    state = F.when(F.col("has").isNull(), "missing").when(F.coalesce("source_hash", F.lit("")) != F.coalesce("content_hash", F.lit("")), "stale")
    return j.select("doc_id", state.alias("state")).filter("state is not null")


def content_groups(documents: DataFrame) -> DataFrame:
    """(content_hash, keeper, copies) of contents that occur more than once."""
    return documents.filter("content is not null").groupBy(text.sha(F.col("content")).alias("content_hash")).agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def after_delete(snapshots: DataFrame, gone: DataFrame) -> DataFrame:
    """Snapshots of deleted documents stay, without their doc_id."""
    marked = snapshots.join(gone.select("doc_id", F.lit(True).alias("gone")).distinct(), "doc_id", "left")
    return marked.withColumn("doc_id", F.when(F.col("gone").isNull(), F.col("doc_id"))).drop("gone")


def sync(parsed: DataFrame, pages: DataFrame, at: datetime) -> DataFrame:
    """The version table after a batch of pages: (doc_id, content_hash, title, content, language, version, quality_score,
    first_seen_at, last_seen_at, is_current, changed).

    parsed: the table before (may be empty); pages: (doc_id, title, content, language, content_hash), one row for each
    document. A known hash is seen again and current once more, a new one gets the document's next version; all other
    versions of a synced document are no longer current. Running a batch again changes nothing but ``last_seen_at``.
    """
    clean = lambda c: text.clean_space(F.col(c))
    new = pages.filter("doc_id is not null and content_hash is not null").select("doc_id", "content_hash", clean("title").alias("title"), clean("content").alias("content"), text.normal_language(F.col("language")).alias("language"), F.lit(True).alias("here"))
    old = parsed.select("doc_id", "content_hash", "title", "content", "language", "version", "quality_score", "first_seen_at", "last_seen_at", "is_current")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.doc_id") == F.col("n.doc_id")) & (F.col("o.content_hash") == F.col("n.content_hash")), "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    rows = both.select(pick("doc_id"), pick("content_hash"), pick("title"), pick("content"), pick("language"), "o.version", "o.quality_score", "o.first_seen_at", "o.last_seen_at", F.coalesce("o.is_current", F.lit(False)).alias("was"), F.coalesce("n.here", F.lit(False)).alias("here"))
    by_doc = Window.partitionBy("doc_id")
    synced, last, now = F.bool_or("here").over(by_doc), F.coalesce(F.max("version").over(by_doc), F.lit(0)), F.lit(at)
    fresh = F.col("version").isNull()
    return rows.select(
        "doc_id", "content_hash", "title", "content", "language",
        F.when(fresh, last + 1).otherwise(F.col("version")).cast("int").alias("version"),
        F.when(fresh, text.quality_score(F.col("title"), F.col("content"))).otherwise(F.col("quality_score")).alias("quality_score"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(F.col("here"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(synced, F.col("here")).otherwise(F.col("was")).alias("is_current"),
        fresh.alias("changed"),
    )


PARSED = "doc_id bigint, content_hash string, title string, content string, language string, version int, quality_score double, first_seen_at timestamp, last_seen_at timestamp, is_current boolean"


def active_chunks(parsed: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_id, version, chunk_index, content, token_count, content_hash, quality_score): chunks of the current versions."""
    return chunks(parsed.filter("is_current"), config, keep=("version",))
