"""JSON-lines sources, report sinks and run management on any Hadoop file system."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.expect import ExpectationError, require_rows
from ..operators.selection import ranked
from ..operators.trajectories import messages


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, path, number`` (from 1, blank lines count) and ``cut_off`` of every line, of files in any number of splits.

    Each split's lines are counted, and running sums of the counts over a
    file's splits give each split its first number, so no file is read as one
    value; the files are read twice.  A file's last line is cut off if its
    bytes are one less than those of its lines with their ends.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id")
    )
    splits = rows.groupBy("path", "block", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    file = W.partitionBy("path")  # one row a split
    before = F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "block", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(file).alias("last"), (F.sum("bytes").over(file) == F.col("size") + 1).alias("open"))
    numbered = rows.drop("size").join(splits, ["path", "block"]).withColumn("number", F.col("id") + F.col("shift"))
    found = numbered.select("line", "path", "number", (F.col("open") & (F.col("number") == F.col("last"))).alias("cut_off"))
    return found.sortWithinPartitions("path", "number")  # the lines of a split stay in order


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, path`` of every line that is not blank."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")).filter(F.trim("line") != "")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is no JSON object raises with its ``path:line``."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    ok = F.ltrim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    where = F.concat(F.col("path"), F.lit(":"), F.col("number").cast("string"))
    text = F.when(ok, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object at "), where, F.lit(": "), F.left("line", F.lit(80)))).cast("string"))
    return lines.select(F.from_json(text, schema).alias("r")).select("r.*")


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and one row with the number of lines that are no JSON objects."""
    lines = read_lines(spark, path).withColumn("ok", F.ltrim("line").startswith("{") & F.try_parse_json("line").isNotNull())
    return lines.filter("ok").select(F.from_json("line", schema).alias("r")).select("r.*"), lines.agg(F.count_if(~F.col("ok")).alias("bad"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One whole-file JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_logs(rows: DataFrame, path: str, log: str, *order: str) -> None:
    """Lines of many logs packed into text files: the log's name, a tab, and the line.

    ``rows`` has the name ``log``, the ``line`` and the columns in whose order a
    log's lines stand.  A log lies in one file; how many files there are follows
    the bytes, not the number of logs, as each new file costs a file system
    milliseconds.  A name with a tab or line end, or a line with a line end,
    raises; a null name counts as an empty one.
    """
    name, line = F.coalesce(F.col(log).cast("string"), F.lit("")), F.coalesce("line", F.lit(""))
    bad = name.rlike("[\t\n]") | line.contains("\n")
    packed = F.when(bad, F.raise_error(F.concat(F.lit("not one line of a log: "), name)).cast("string")).otherwise(F.concat(name, F.lit("\t"), line))
    rows.repartition(log).sortWithinPartitions(log, *order).select(packed.alias("value")).write.option("lineSep", "\n").text(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, id, log, line`` of packed logs: ``block`` and ``id`` order the lines of a file, of any number of splits."""
    value, at = F.col("value"), F.instr("value", "\t")
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.nullif(F.left(value, at - 1), F.lit("")).alias("log"), F.substr(value, at + 1).alias("line"))


EVENT_FIELDS = ("event_type", "trajectory_id", "question_id", "payload")


def event_fields() -> list[Column]:
    return [*(F.get_json_object("line", f"$.{c}").alias(c) for c in EVENT_FIELDS), F.get_json_object("line", "$.timestamp").try_cast("double").alias("timestamp")]


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """All event files at once: ``file, seq`` and the event's fields; ``seq`` is the place in the file, from 0."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    return lines.select(F.col("path").alias("file"), (F.col("number") - 1).alias("seq"), *event_fields())


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """All events of packed logs: ``file, log, seq`` and the event's fields; ``seq`` is the place in the log, from 0.  The files are read once."""
    place = F.row_number().over(W.partitionBy("path", "log").orderBy("block", "id"))
    lines = read_logs(spark, path).withColumn("seq", place - 1).filter(F.trim("line") != "")
    return lines.select(F.col("path").alias("file"), "log", "seq", *event_fields())


def config(text: str, env: dict[str, str] | None = None) -> dict:
    """JSON configuration with ${NAME} replaced, as JSON text, from the environment; a name that is not set raises."""
    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise ExpectationError(f"environment variable {m[1]} is not set")
        return json.dumps(env[m[1]], ensure_ascii=False)[1:-1]

    return json.loads(re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", value, text))


def write_lines(df: DataFrame, path: str) -> int:
    """Write JSON lines to a new folder; returns the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header to a new folder; refuses an empty table."""
    require_rows(df, path).write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def write_by(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in one folder a key."""
    df.write.mode("errorifexists").partitionBy(key).json(path)


def document(df: DataFrame) -> str:
    """A one-row table as an indented JSON document."""
    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), ensure_ascii=False, indent=2) + "\n"


def markdown(df: DataFrame) -> str:
    """A report table as Markdown, floats with four digits."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()]) + "\n"


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files: compare before and after with ``same_set``."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pending(questions: DataFrame, committed: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a committed result: what a resumed run still has to do."""
    return questions.join(committed.select(key), key, "left_anti")


def same_identity(now: DataFrame, before: DataFrame, *keys: str) -> bool:
    """Whether two one-row manifests agree in all keys."""
    return now.select(*keys).exceptAll(before.select(*keys)).isEmpty() and not now.isEmpty()


def sft_rows(candidates: DataFrame, order: Column, prefix: str = "sft") -> DataFrame:
    """Numbered training samples of candidates."""
    numbered = ranked(candidates.select("question_id", "trajectory_id", "question", messages().alias("messages"), order.alias("__o")), [F.col("__o"), F.col("trajectory_id")], "__n")
    return numbered.select(F.format_string(f"{prefix}-%04d", F.col("__n") + 1).alias("sample_id"), "question_id", "trajectory_id", "question", "messages")


def token_audit(rows: DataFrame, length: str, cutoff: int) -> DataFrame:
    """Totals after truncation and the share of truncated rows."""
    n, over = F.count("*"), F.count_if(F.col(length) > cutoff)
    return rows.agg(n.alias("rows"), F.coalesce(F.sum(F.least(F.col(length), F.lit(cutoff))), F.lit(0)).alias("tokens"), over.alias("truncated"), F.when(n > 0, over / n).otherwise(0.0).alias("truncation_rate"))
