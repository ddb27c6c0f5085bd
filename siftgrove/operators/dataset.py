"""Dataset factory: export rows, manifest, distillation samples, run and model registries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import text
from .versions import chunks


def plain_text(documents: DataFrame, min_quality: float = 0.15) -> DataFrame:
    """(doc_id, url, title, language, quality_score, text) of documents good enough for export."""
    score = text.quality_score(F.col("title"), F.col("content"))
    rows = documents.select("doc_id", "url", F.coalesce("title", F.lit("")).alias("title"), text.normal_language(F.col("language")).alias("language"), score.alias("quality_score"), text.clean_space(F.col("content")).alias("text"))
    return rows.filter((F.col("quality_score") >= min_quality) & (F.col("text") != ""))


def grounded(documents: DataFrame, min_quality: float = 0.15) -> DataFrame:
    """(doc_id, chunk_index, url, title, text, quality_score): chunks with what they come from, in one pass."""
    parts = chunks(documents, keep=("url", "title")).filter(F.col("quality_score") >= min_quality)
    return parts.select("doc_id", "chunk_index", "url", F.coalesce("title", F.lit("")).alias("title"), F.col("content").alias("text"), "quality_score")


def manifest(documents: DataFrame, min_quality: float = 0.15) -> DataFrame:
    """(documents, chunks) of an export: one scan, chunks counted from the number of words without cutting any."""
    rows = documents.select(text.quality_score(F.col("title"), F.col("content")).alias("q"), F.size(text.words(F.col("content"))).alias("n")).filter(F.col("q") >= min_quality)
    m, step = ChunkConfig().max_tokens, max(1, ChunkConfig().max_tokens - ChunkConfig().overlap)
    each = text.once(F.col("n"), lambda n: F.when(n == 0, 0).when(n <= m, 1).otherwise(F.ceil((n - m + step) / step)))
    count = F.coalesce(F.sum(each), F.lit(0)).cast("bigint")
    return rows.agg(F.count_if(F.col("n") > 0).alias("documents"), count.alias("chunks"))


def write_dataset(documents: DataFrame, path: str, version: str, min_quality: float = 0.15) -> None:
    """JSON lines of documents and chunks, and the manifest, below ``path``/``version``."""
    plain_text(documents, min_quality).write.mode("overwrite").json(f"{path}/{version}/plain_text")
    grounded(documents, min_quality).write.mode("overwrite").json(f"{path}/{version}/grounded_sources")
    manifest(documents, min_quality).withColumn("dataset_version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{path}/{version}/manifest")


QUESTION = " hakkinda ne anlatiliyor?"


def distill_samples(documents: DataFrame, limit: int = 50, known: DataFrame | None = None, teacher: Callable[[list[dict]], list[str | None]] | None = None) -> DataFrame:
    """(doc_id, chunk_index, question, answer, sample_hash, used_fallback) of the best chunks, without samples known before.

    ``teacher`` answers a batch of chunks (title, url, content) with JSON texts of question and answer; where it gives
    none that can be read, and without a teacher, the sample is made from title and beginning of the chunk.
    """
    best = grounded(documents, 0.0).orderBy(F.desc("quality_score"), "doc_id", "chunk_index").limit(limit)
    rows = best.withColumn("said", F.lit(None).cast("string")) if teacher is None else _taught(best, teacher)
    said = F.from_json("said", "question string, answer string")
    rows = rows.withColumn("q", F.trim(said["question"])).withColumn("a", F.trim(said["answer"])).withColumn("used_fallback", ~(F.coalesce(F.col("q") != "", F.lit(False)) & F.coalesce(F.col("a") != "", F.lit(False))))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url")
    made = rows.select("doc_id", "chunk_index", F.when(F.col("used_fallback"), F.concat(title, F.lit(QUESTION))).otherwise(F.col("q")).alias("question"), F.when(F.col("used_fallback"), F.trim(F.substring("text", 1, 700))).otherwise(F.col("a")).alias("answer"), "used_fallback")
    hashed = made.withColumn("sample_hash", text.sha(F.concat_ws("\u0001", "question", "answer")))
    first = Window.partitionBy("sample_hash").orderBy("doc_id", "chunk_index")
    out = hashed.withColumn("at", F.row_number().over(first)).filter("at = 1").drop("at")
    return out.join(known.select("sample_hash"), "sample_hash", "left_anti") if known is not None else out


def _taught(chunks_: DataFrame, teacher: Callable) -> DataFrame:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = [{"title": t, "url": u, "content": c[:1600]} for t, u, c in zip(b["title"], b["url"], b["text"])]
            yield b.assign(said=pd.Series(teacher(asked), index=b.index, dtype=object))

    return chunks_.mapInPandas(ask, chunks_.schema.simpleString()[7:-1].replace(":", " ") + ", said string")


def distill_counters(documents: DataFrame, limit: int = 50, known: DataFrame | None = None, teacher: Callable | None = None) -> DataFrame:
    """(created, skipped, fallback_count, teacher_success_count) of a run over the best chunks."""
    samples = distill_samples(documents, limit, None, teacher)
    fresh = samples.join(known.select("sample_hash"), "sample_hash", "left_anti") if known is not None else samples
    tried = grounded(documents, 0.0).limit(limit).agg(F.count(F.lit(1)).alias("tried"))
    made = fresh.agg(F.count(F.lit(1)).alias("created"))
    how = samples.agg(F.count_if("used_fallback").alias("fallback_count"), F.count_if(~F.col("used_fallback")).alias("teacher_success_count"))
    return made.crossJoin(how).crossJoin(tried).select("created", (F.col("tried") - F.col("created")).alias("skipped"), "fallback_count", "teacher_success_count")


def evaluate(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("sample_hash").alias("distinct_samples"))


def registry(published: DataFrame) -> DataFrame:
    """(model_name, model_version, provider, is_active, published_at): one row per version, the last published active."""
    last = Window.partitionBy("model_name", "model_version").orderBy(F.desc("published_at"))
    rows = published.withColumn("at", F.row_number().over(last)).filter("at = 1")
    newest = F.row_number().over(Window.partitionBy("model_name").orderBy(F.desc("published_at"), F.desc("model_version"))) == 1
    return rows.select("model_name", "model_version", "provider", newest.alias("is_active"), "published_at")


def run_log(runs: DataFrame) -> DataFrame:
    """Runs with seconds taken, number of seeds, and empty notes as null."""
    seconds = F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6, 3)
    return runs.select("crawl_run_id", "status", F.coalesce(F.size("seed_urls"), F.lit(0)).alias("n_seeds"), seconds.alias("seconds"), F.nullif(F.trim("notes"), F.lit("")).alias("notes"))


def training_log(runs: DataFrame) -> DataFrame:
    """(model_name, run_id, teacher, epochs, config): settings of recorded runs, read from their JSON; the rest stays as text.

    No training happens: a run is a record with its settings, as in the registry."""
    settings = F.from_json("config_json", "teacher string, epochs int, learning_rate double")
    return runs.select("model_name", "run_id", settings["teacher"].alias("teacher"), F.coalesce(settings["epochs"], F.lit(0)).alias("epochs"), F.coalesce(F.when(settings.isNotNull(), F.to_json(settings)), F.lit("{}")).alias("config"))


def dataset_name(prefix: str, at: Column) -> Column:
    """Default version of a data set: prefix, date and time."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(at, "yyyyMMdd_HHmmss"))
