"""Inverted index as derived tables: postings, document frequencies, lengths, statistics, and changes to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import removed_at_end, shared_dir
from ..config import RankConfig
from ..functions import text


def corpus(documents: DataFrame) -> DataFrame:
    """The columns search works on, nulls as empty strings; column pruning keeps content out of where it isn't asked."""
    return documents.select(
        "doc_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        text.normal_language(F.col("language")).alias("language"),
        "last_crawled",
    )


def lengths(documents: DataFrame) -> DataFrame:
    """(doc_id, dl): body tokens without stop words."""
    return documents.select("doc_id", F.size(text.tokens(F.col("content"))).alias("dl"))


def statistics(documents: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl)."""
    return lengths(documents).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(documents: DataFrame, terms: list[str] | None = None, config: RankConfig = RankConfig()) -> DataFrame:
    """(term, doc_id, tf): body tokens count 1, title tokens ``title_boost``; one scan, counted before the shuffle.

    ``terms`` keeps only the postings of these terms, before anything is exploded or shuffled.
    """
    keep = (lambda c: F.filter(text.tokens_all(c), lambda t: t.isin(*terms))) if terms is not None else text.tokens
    marked = lambda c, w: F.transform(keep(c), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    both = F.concat(marked(F.col("content"), 1), marked(F.col("title"), max(1, config.title_boost)))
    # the outer explode keeps Catalyst from computing the tokens once more as a filter below
    pairs = documents.select("doc_id", F.explode_outer(both).alias("p")).filter("p is not null").select("doc_id", "p.term", "p.w")
    return pairs.groupBy("term", "doc_id").agg(F.sum("w").alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def upsert(posts: DataFrame, changed: DataFrame, config: RankConfig = RankConfig()) -> DataFrame:
    """Postings after the changed documents are indexed anew: anti-join by document, then union."""
    fresh = postings(changed, config=config)
    return posts.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of any child table whose document isn't deleted."""
    return df.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def not_indexed(documents: DataFrame, posts: DataFrame) -> DataFrame:
    return documents.join(posts.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on url: new values win, ``next_crawl_at`` stays where the new row has none; language normalised."""
    n = new.select("url", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "url"], F.lit(True).alias("is_new"))
    joined = old.join(n, "url", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if c in ("next_crawl_at", "doc_id") else F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c))
    cols = [F.col("url") if c == "url" else (text.normal_language(pick(c)) if c == "language" else pick(c)).alias(c) for c in old.columns if c == "url" or c in new.columns]
    return joined.select(*cols)


#: Folders the stored postings are split into by term; a query reads those of its terms only.
BUCKETS = 32


class StoredIndex:
    """Postings on disk: (term, doc_id, tf, dl, language) in folders by hash of the term, sorted by term within each file.

    A search reads the folders of its terms, and of these the row groups whose term range fits; the corpus itself is
    read for the candidates only. ``statistics`` is one row (n_docs, avgdl).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, documents: DataFrame, path: str, config: RankConfig = RankConfig()) -> StoredIndex:
        docs = corpus(documents)
        body = text.tokens(F.col("content"))
        marked = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
        both = F.concat(marked(body, 1), marked(text.tokens(F.col("title")), max(1, config.title_boost)))
        # the length is taken before the explode, else it is computed for every token
        whole = docs.select("doc_id", "language", F.size(body).alias("dl"), both.alias("p"))
        each = whole.select("doc_id", "language", "dl", F.explode_outer("p").alias("p")).filter("p is not null")
        # one row for each term of a document: all its tokens are in one task, so this count needs no shuffle of its own
        rows = each.groupBy("p.term", "doc_id", "dl", "language").agg(F.sum("p.w").alias("tf"))
        placed = rows.withColumn("bucket", bucket(F.col("term")))
        # hot terms are split by document, into as many parts as the cluster's shuffles have for each folder
        parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        placed.repartition("bucket", F.pmod(F.hash("doc_id"), F.lit(parts))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        statistics(documents).coalesce(1).write.parquet(f"{path}/statistics")
        return cls(documents.sparkSession, path)

    def postings(self, terms: list[str]) -> DataFrame:
        rows = self.spark.read.schema("term string, doc_id bigint, dl int, language string, tf bigint, bucket int").parquet(f"{self.path}/postings")
        # the buckets of literal terms are folded to constants, so the filter prunes folders
        return rows.filter(F.col("bucket").isin(*[bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms)).select("term", "doc_id", "dl", "language", "tf")

    def vocabulary(self) -> DataFrame:
        """(term, df): reads the term column only."""
        return self.spark.read.parquet(f"{self.path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def statistics(self) -> DataFrame:
        return self.spark.read.schema("n_docs bigint, avgdl double").parquet(f"{self.path}/statistics")


def bucket(term):
    return F.pmod(F.hash(term), F.lit(BUCKETS)).cast("int")


_STORED: dict[tuple[str, str], StoredIndex] = {}


def stored_index(documents: DataFrame, name: str) -> StoredIndex:
    """The index of a corpus in the shared folder; built at its first use in a session, removed at the session's end."""
    spark = documents.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}-{len(_STORED)}"
        removed_at_end(spark, path)
        _STORED[key] = StoredIndex.build(documents, path)
    return _STORED[key]
