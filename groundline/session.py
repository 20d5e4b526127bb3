"""Session settings the jobs rely on.

Only runtime SQL settings are touched, so the same code works on a session that
a cluster or a test already made.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold this many narrow rows; beyond it the jobs shuffle.
BROADCAST_ROW_LIMIT = 200_000
# And rows that carry text as many characters in all, each at most four bytes.
BROADCAST_CHARACTER_LIMIT = 32_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the plans are written for and return the session."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Hot documents are split, so joins on several keys are not left where one of them is; see meet_where_dealt.
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def meet_where_dealt(spark: SparkSession) -> None:
    """Let rows that are dealt by one key meet on it and others without a further shuffle, until the next ``tune``."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only a local session may go without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """Count a side, stopping just past the limit, before it may be broadcast."""
    return df.limit(limit + 1).count() <= limit


def bytes_fit_broadcast(df: DataFrame, characters: Column, limit: int = BROADCAST_CHARACTER_LIMIT) -> bool:
    """Add up the characters a side carries before it may be broadcast."""
    return (df.agg(F.sum(characters)).first()[0] or 0) <= limit
