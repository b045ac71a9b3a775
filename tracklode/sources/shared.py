"""The folder that driver and executors share, for tables a plan has to write before it goes on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; unset, a temporary one on a local master, and an error on any other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="tracklode-shared-"))
    return _made[0]


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
