"""BM25 for many queries at once, then rerank: quality filters, title dedupe, proximity, freshness, domain cap."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions import text, urls
from . import fuzzy
from .index import StoredIndex, corpus, document_frequencies, lengths


def query_terms(queries: list[tuple[int, str]]) -> list[tuple[int, str, int, int]]:
    """(query_id, term, qtf, pos): tokens of each query, repeats counted, first place kept; no job."""
    out = []
    for query_id, query in queries:
        words = text.tokens_of(query) if isinstance(query, str) else list(query)
        out += [(query_id, t, words.count(t), words.index(t)) for t in dict.fromkeys(words)]
    return out


def matches(docs: DataFrame, terms: list[str], config: RankConfig = RankConfig()) -> DataFrame:
    """(term, doc_id, dl, language, tf): postings of some terms straight from the documents, one scan and one small shuffle."""
    body, head = text.tokens_all(F.col("content")), text.tokens_all(F.col("title"))
    kept = lambda c, w: F.transform(F.filter(c, lambda t: t.isin(*terms)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    some = docs.select("doc_id", "language", F.size(text.without_stopwords(body)).alias("dl"), F.concat(kept(body, 1), kept(head, max(1, config.title_boost))).alias("p"))
    return some.select("doc_id", "dl", "language", F.explode_outer("p").alias("p")).filter("p is not null").groupBy("p.term", "doc_id", "dl", "language").agg(F.sum("p.w").alias("tf"))


def bm25(source: DataFrame | StoredIndex, queries: list[tuple[int, str]], config: RankConfig = RankConfig(), limit: int | None = None, preferred: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, base_rank) of the best ``limit`` documents of each query.

    From a stored index only the postings of the queries' terms are read; documents without one are tokenised in passing.
    A query is a text, or a list of terms. The query list comes from the caller's memory, so its tables are broadcast. Terms above ``max_df_ratio`` only add
    to documents that a rarer term, or one of the two rarest, has found: a flag of the score's aggregation instead of an ordered loop.
    """
    rows = query_terms(queries)
    terms = sorted({r[1] for r in rows})
    if isinstance(source, StoredIndex):
        spark, posts = source.spark, source.postings(terms)
        stats = source.statistics().select("n_docs", F.coalesce(F.nullif("avgdl", F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    else:
        docs = corpus(source)
        spark, posts = docs.sparkSession, matches(docs, terms, config)
        stats = lengths(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    asked = spark.createDataFrame(rows, "query_id int, term string, qtf int, pos int")
    order = Window.partitionBy("query_id").orderBy("df", "pos")
    plan = (
        asked.join(document_frequencies(posts), "term")
        .crossJoin(stats)
        .withColumn("rn", F.row_number().over(order))
        .withColumn("expands", (F.col("rn") <= config.seed_terms) | (F.col("df") <= F.greatest(F.lit(1.0), config.max_df_ratio * F.col("n_docs"))))
    )
    hits = posts.join(F.broadcast(plan), "term")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")) + 1e-9)
    # a document counts if any term that may expand has found it
    scores = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * weight), 6).alias("score"), F.bool_or("expands").alias("found"), F.first("language").alias("language")).filter("found").drop("found")
    if preferred:
        same = F.col("language").startswith(preferred)
        some = scores.groupBy("query_id").agg(F.bool_or(same).alias("some"))  # one row a query
        spoken = scores.join(F.broadcast(some), "query_id").filter(same | ~F.col("some"))
        scores = spoken.withColumn("score", F.when(~same & (F.col("language") != ""), F.round(F.col("score") * config.other_language_penalty, 6)).otherwise(F.col("score")))
    scores = scores.select("query_id", "doc_id", "score")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("base_rank", F.row_number().over(rank)).filter(F.col("base_rank") <= (limit or config.top_k))


def title_key(title: Column) -> Column:
    return text.fold(text.clean_space(title))


def proximity(content: Column, terms: list[str]) -> Column:
    """``1 / (1 + gap / 80)`` for the least gap between first places of at least two terms; else 0."""
    if len(terms) < 2:
        return F.lit(0.0)
    folded = text.fold(content)
    places = F.array_sort(F.filter(F.array(*[F.locate(t, folded) for t in terms]), lambda p: p > 0))
    gaps = F.when(F.size(places) >= 2, F.array_min(F.zip_with(F.slice(places, 2, len(terms)), F.slice(places, 1, F.size(places) - 1), lambda b, a: b - a)))
    return F.coalesce(1 / (1 + gaps / 80.0), F.lit(0.0))


def freshness(last_crawled: Column, as_of: datetime, days: float) -> Column:
    """``1 - age / days`` up to that age, above 1 for dates in the future; null dates give 0."""
    age = (F.lit(as_of.timestamp()) - F.unix_micros(last_crawled) / 1e6) / 86400
    return F.coalesce(F.when(age <= days, 1 - age / days), F.lit(0.0))


def title_share(title: Column, terms: list[str]) -> Column:
    folded = text.fold(title)
    return sum((F.when(folded.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / max(1, len(terms))


def quality_flags(config: RankConfig) -> Column:
    """Least tokens and least share of different tokens, on a column ``content``."""
    all_ = text.tokens_all(F.col("content"))
    return (F.size(all_) >= config.min_tokens) & (F.size(F.array_distinct(all_)) >= config.min_unique_ratio * F.size(all_))


def allowed_url(url: Column, config: RankConfig) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(True)
    for part in config.excluded_urls:
        out = out & ~low.contains(part)
    return out


def domain_cap(ranked: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    """At most ``cap`` rows of a domain in a query, empty domains free; 0 or less switches it off."""
    if cap <= 0:
        return ranked
    at = F.row_number().over(Window.partitionBy("query_id", "domain").orderBy(*order))
    return ranked.withColumn("at", at).filter((F.col("domain") == "") | (F.col("at") <= cap)).drop("at")


def chosen(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Corpus rows of a few candidates: their ids (``initial_k`` at most) reach the scan as a filter."""
    rows = candidates.collect()
    few = documents.sparkSession.createDataFrame(rows, candidates.schema)
    return corpus(documents.filter(F.col("doc_id").isin([r.doc_id for r in rows]))).join(F.broadcast(few), "doc_id")


def rerank(documents: DataFrame, candidates: DataFrame, terms: list[str], as_of: datetime, config: RankConfig = RankConfig(), preferred: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of one query's candidates. Content is read for candidates only."""
    rows = chosen(documents, candidates)
    if preferred and config.strict_language:
        rows = rows.filter(F.col("language").startswith(preferred))
    rows = rows.filter(allowed_url(F.col("url"), config) & quality_flags(config)).withColumn("key", title_key(F.col("title")))
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("base_rank"))
    rows = rows.withColumn("copy", first).filter((F.col("key") == "") | (F.col("copy") == 1))
    factor = 1 + config.title_weight * title_share(F.col("title"), terms) + config.proximity_weight * proximity(F.col("content"), terms) + config.freshness_weight * freshness(F.col("last_crawled"), as_of, config.fresh_days)
    scored = rows.select("query_id", "doc_id", "base_rank", urls.netloc(F.col("url")).alias("domain"), F.round(F.col("score") * factor, 6).alias("score"))
    capped = domain_cap(scored, config.max_per_domain, [F.desc("score"), F.col("base_rank")])
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_rank"))
    return capped.withColumn("rank", last).filter(F.col("rank") <= config.top_k).select("query_id", "doc_id", "score", "rank")


def search(documents: DataFrame, query: str | list[str], as_of: datetime, config: RankConfig = RankConfig(), preferred: str | None = None, index: StoredIndex | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 candidates, then rerank."""
    terms = text.tokens_of(query) if isinstance(query, str) else query
    return rerank(documents, bm25(index or documents, [(1, terms)], config, config.initial_k, preferred), terms, as_of, config, preferred)


def parsed_terms(answer: str | None, most: int = 6) -> list[str]:
    """Terms of an expander's answer: a list with commas, line breaks as blanks."""
    return [p for p in (x.strip() for x in (answer or "").replace("\n", " ").split(",")) if p][:most]


def search_with_fuzzy(documents: DataFrame, index: StoredIndex, query: str, as_of: datetime, config: RankConfig = RankConfig(), preferred: str | None = None, expand: Callable[[str], str] | None = None, correct: bool = True) -> tuple[DataFrame, dict[str, str], list[str]]:
    """(results, corrections, used terms): expansion by the caller's function, typo correction, BM25, rerank."""
    extra = ", ".join(parsed_terms(expand(query))) if expand else ""
    terms = text.tokens_of(f"{query} {extra}".strip())
    changes: dict[str, str] = {}
    if correct and terms:
        # terms with postings are right as they are; only the rest is compared with the vocabulary
        there = {r.term for r in index.postings(terms).select("term").distinct().collect()}
        wrong = [t for t in dict.fromkeys(terms) if t not in there]
        if wrong:
            found = {r.term: r.corrected for r in fuzzy.correct(index.vocabulary(), wrong).collect()}
            changes = {t: c for t, c in found.items() if t != c}
    used = [changes.get(t, t) for t in terms]
    return search(documents, used, as_of, config, preferred, index), changes, used


def api_results(documents: DataFrame, results: DataFrame, terms: list[str], radius: int = 120) -> DataFrame:
    """(rank, doc_id, url, title, score, language, length, snippet) of search results, as the interface gives them."""
    body = F.col("content")
    rows = chosen(documents, results)
    return rows.select("rank", "doc_id", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "score", "language", F.size(text.tokens(body)).alias("length"), text.snippet(body, terms, radius).alias("snippet"))


def with_snippets(documents: DataFrame, results: DataFrame, terms: list[str], radius: int = 120) -> DataFrame:
    """(query_id, rank, doc_id, url, title, score, snippet): titles fall back to the address."""
    rows = chosen(documents, results)
    return rows.select("query_id", "rank", "doc_id", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "score", text.snippet(F.col("content"), terms, radius).alias("snippet"))
