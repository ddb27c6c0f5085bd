"""Exact vector search: cosine against one or a few query vectors, similar documents, candidates, embedding build."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .versions import stale_embeddings


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-9, 0.0).otherwise(dot(a, b) / n)


def of_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull()))


def find_similar(vectors: DataFrame, query: list[float], top_k: int = 10, exclude: list[int] = ()) -> DataFrame:
    """(doc_id, score): one scan with a literal query vector and a partial top-k in every task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = of_dimension(vectors, len(query)).filter(~F.col("doc_id").isin(*exclude)) if exclude else of_dimension(vectors, len(query))
    return rows.select("doc_id", F.round(cosine(F.col("vector"), q), 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_k)


def find_similar_to(vectors: DataFrame, doc_id: int, top_k: int = 10) -> DataFrame:
    row = vectors.filter(F.col("doc_id") == doc_id).select("vector").head()
    if row is None or row.vector is None:
        return vectors.sparkSession.createDataFrame([], "doc_id bigint, score double")
    return find_similar(vectors, row.vector, top_k, [doc_id])


def among_candidates(vectors: DataFrame, query: list[float], candidates: DataFrame, top_k: int = 10) -> DataFrame:
    return find_similar(vectors.join(candidates.select("doc_id"), "doc_id", "left_semi"), query, top_k)


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed hashes of all words (the reference cuts at 512), unit length."""
    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def build_embeddings(documents: DataFrame, existing: DataFrame, embed: Callable, only_missing: bool = True) -> DataFrame:
    """(doc_id, vector, source_hash) of documents without an embedding or with a stale one, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "vector": pd.Series(embed(b.text.tolist()), dtype=object), "source_hash": b.source_hash})

    todo = documents.join(stale_embeddings(documents, existing).select("doc_id"), "doc_id", "left_semi") if only_missing else documents
    rows = todo.select("doc_id", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("text"), F.col("content_hash").alias("source_hash"))
    return rows.mapInPandas(run, "doc_id bigint, vector array<float>, source_hash string")


__all__ = ["among_candidates", "build_embeddings", "cosine", "dot", "find_similar", "find_similar_to", "hashing_embedder", "norm", "of_dimension", "text"]
