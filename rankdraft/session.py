"""Session helpers: durable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table this engine broadcasts, counted as string bytes plus ROW_BYTES a row.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a new temporary one on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rankdraft-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage by a reliable checkpoint.

    Later passes over the result see the same rows in the same partitions, also
    after executors were lost.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table_bytes(df: DataFrame) -> int:
    """Size of a narrow table once broadcast; call it on scans and checkpoints."""
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    row = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(ROW_BYTES))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return table_bytes(df) <= limit
