"""Session defaults and the few settings every job shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_spark(app: str = "tagloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``master`` is only given for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors have to reach the same place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or None
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tagloom-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Later steps start from the files and read only the columns they name, so a lost executor costs no recomputation and
    every reader sees the same rows.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many ids may be sent to every executor at once, some 16 bytes each.
SENT_IDS = 1 << 19


def known_ids(rows: DataFrame, name: str = "doc_id") -> tuple[DataFrame, bool]:
    """The different values of a column, stored, and whether they are few enough to be sent to every executor; then they are marked so."""
    ids = stored(rows.select(name).distinct(), "ids")
    few = ids.count() <= SENT_IDS
    return (F.broadcast(ids) if few else ids), few


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so iterative jobs survive a lost executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)
