"""Session helpers shared by all operators: table access, the cluster's shared folder, tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables whose rows take much computing.
TEXT_TABLES = ("documents",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; parquet keeps column pruning and filter pushdown available to Catalyst.

    A table of long texts in so few files that most cores would idle is spread over them (projections and filters
    still reach the scan). Inputs with as many splits as half the cores, so any large input, are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() * 2 < cores:
        return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is missing in local mode (tests) a temporary folder is made and set; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftgrove-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with replicated or shared storage, so a lost executor costs no recomputation of what came
    before. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed_at_end(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing will read again."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, file)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, context = spark._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster's own clean-up applies
        pass
