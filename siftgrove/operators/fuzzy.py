"""Typo correction: candidates by shared k-grams, then a blend of sequence ratio and Jaccard similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import FuzzyConfig
from ..functions import text


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; Spark has no built-in for it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def shortlist(vocabulary: DataFrame, terms: list[str], config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """(query_term, term, jaccard, at): the best vocabulary terms sharing a gram with each query term.

    An equi-join on grams replaces the comparison with the whole vocabulary; the query's grams are a few words of the
    caller. Ties go by term, so the result doesn't depend on hash order.
    """
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted(set(terms))], "query_term string").withColumn("q_grams", text.kgrams(F.col("query_term"), config.k))
    asked = asked.select("query_term", F.size("q_grams").alias("nq"), F.explode("q_grams").alias("gram"))
    grams = vocabulary.select("term").withColumn("grams", text.kgrams(F.col("term"), config.k)).select("term", F.size("grams").alias("nt"), F.explode_outer("grams").alias("gram"))
    shared = grams.join(F.broadcast(asked), "gram").groupBy("query_term", "term", "nq", "nt").agg(F.count(F.lit(1)).alias("both"))
    scored = shared.select("query_term", "term", F.round(F.col("both") / (F.col("nq") + F.col("nt") - F.col("both")), 6).alias("jaccard")).filter(F.col("jaccard") >= config.jaccard_min)
    order = Window.partitionBy("query_term").orderBy(F.desc("jaccard"), "term")
    return scored.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= config.shortlist)


def correct(vocabulary: DataFrame, terms: list[str], config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """(term, corrected, score): terms of the vocabulary stay; others take the best candidate above the cutoff.

    A term without any shortlisted candidate is compared with the whole vocabulary by ratio alone.
    """
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    unknown = asked.join(vocabulary.select("term").distinct(), "term", "left_anti")
    missing = [r.term for r in unknown.collect()]  # the caller's own words
    near = shortlist(vocabulary, missing, config)
    blend = config.ratio_weight * sequence_ratio("query_term", "term") + (1 - config.ratio_weight) * F.col("jaccard")
    scored = near.select("query_term", "term", "jaccard", blend.alias("score"))
    bare = F.broadcast(unknown.join(near.select(F.col("query_term").alias("term")), "term", "left_anti").withColumnRenamed("term", "query_term"))
    wide = vocabulary.select("term").distinct().crossJoin(bare).select("query_term", "term", F.lit(0.0).alias("jaccard"), sequence_ratio("query_term", "term").alias("score"))
    best = scored.unionByName(wide).groupBy("query_term").agg(F.max_by(F.struct("term", "score"), F.struct("score", "jaccard", F.concat(F.lit(""), F.reverse("term")))).alias("best"))
    chosen = best.filter(F.col("best.score") >= config.cutoff).select(F.col("query_term").alias("term"), F.col("best.term").alias("corrected"), F.round("best.score", 6).alias("score"))
    return asked.join(chosen, "term", "left").select("term", F.coalesce("corrected", "term").alias("corrected"), "score")
