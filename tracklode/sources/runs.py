"""Run folders: one writer at a time, and result files that a crash cut off."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import numbered_lines

#: Name of the file that marks a run folder as taken; fixed value.
LOCK = ".writer.lock"


class LockedError(RuntimeError):
    """Another writer holds the run folder, or died in it."""


def _lock(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{LOCK}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def holder(spark: SparkSession, folder: str, name: str = LOCK) -> str | None:
    """Who holds a run folder; null if nobody does."""
    path = f"{folder}/{name}"
    fs, where = _lock(spark, folder)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(where):
        return None
    f = fs.open(where)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def take_lock(spark: SparkSession, folder: str, resume: bool | str = False) -> str:
    """Claim a run folder on a Hadoop file system whose creates and renames are atomic; returns the new owner's id.

    A create that must not overwrite decides between two writers.  ``resume``
    takes over from a dead writer: the owner's id as the caller has seen it
    (``holder``), or True for whoever holds it now.  The dead one's lock is
    renamed and compared before it goes, so that of two resumers the second
    does not remove the first one's fresh lock.  Object stores without atomic
    create need another lock.
    """
    fs, path = _lock(spark, folder)
    owner = uuid.uuid4().hex
    refused = LockedError(f"{folder} has a writer; resume only when it is known to be dead")
    dead = holder(spark, folder) if resume is True else resume or None
    if dead is not None:
        aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{LOCK}.{owner}")
        if holder(spark, folder) != dead or not fs.rename(path, aside):
            raise refused
        if holder(spark, folder, f"{LOCK}.{owner}") != dead:  # a fresh one, taken in between: it goes back
            fs.rename(aside, path)
            raise refused
        fs.delete(aside, False)
    if fs.exists(path):
        raise refused
    try:
        f = fs.create(path, False)
    except Py4JJavaError as e:
        raise refused from e
    f.write(bytearray(owner.encode()))
    f.close()
    return owner


def release_lock(spark: SparkSession, folder: str) -> None:
    fs, path = _lock(spark, folder)
    fs.delete(path, False)


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line`` of the complete lines of result files: what follows a file's last line end was cut off and goes."""
    return numbered_lines(spark, path).filter(~F.col("cut_off") & (F.trim("line") != "")).select("path", "line")
