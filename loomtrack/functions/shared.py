"""Where jobs put tables that every executor and the driver must be able to read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) a local folder is made and
    registered, so ``DataFrame.checkpoint`` works in both cases.
    """
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(set_by_cluster)
        return set_by_cluster.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-loomtrack-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows up to which a dimension (zones, edges, profiles) is broadcast.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where it was counted to have at most ``rows`` rows, else with a merge hint."""
    return df.hint("broadcast") if df.limit(rows + 1).count() <= rows else df.hint("merge")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably (a lost executor only rereads files) and gives later
    joins true file sizes instead of guesses about generators and Python functions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
