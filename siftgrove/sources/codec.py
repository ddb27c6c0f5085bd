"""Compatibility codec of stored vectors (zlib-compressed little-endian floats) and a table audit."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else zlib.compress(np.asarray(v, dtype="<f4").tobytes(), 6))


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Vectors of blobs; empty or broken blobs give an empty vector."""

    def one(b: bytes | None):
        try:
            return np.frombuffer(zlib.decompress(b), dtype="<f4") if b else np.zeros(0, np.float32)
        except (zlib.error, ValueError):
            return np.zeros(0, np.float32)

    return blobs.map(one)


def audit(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(table, n_rows): row counts of tables, from parquet footers."""
    out = None
    for n in names:
        one = spark.read.parquet(f"{sf_dir}/{n}.parquet").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
