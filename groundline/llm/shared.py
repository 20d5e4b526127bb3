"""The shared folder for cut lineage, and keys that identify a row."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the cluster's shared folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where none is named, a
    local session gets a temporary folder; any other session is an error.
    """
    prepare_folder(df.sparkSession)
    return df.checkpoint()


def prepare_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it while a column is called so."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def row_key() -> Column:
    """One long for a document row; rows that share it have the same id and text (nulls count)."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("text").isNull())
