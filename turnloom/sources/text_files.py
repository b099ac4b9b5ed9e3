"""Text files in order: writers whose lines can be scanned again with their numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.feature_text import file_ranges, numbered
from turnloom.sources.shared import shared_dir


def a_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/turnloom/{tag}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, *order: str, value: str = "value", compression: str | None = None) -> str:
    """Text files whose names, and lines within a file, are in order.  Ranges of lines are written in parallel."""
    lines.orderBy(*order).select(value).write.text(path, compression=compression)
    return path


def through_a_file(lines: DataFrame, tag: str, *order: str, value: str = "value") -> DataFrame:
    """pos (from 1) and value of lines that have been written as text and scanned."""
    return numbered(lines.sparkSession, write_lines(lines, a_path(lines.sparkSession, tag), *order, value=value))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pos, left, right) of two files of one line a row; lines without a word do not count in either.

    Files of different length are an error."""

    def used(lines: DataFrame, name: str) -> DataFrame:
        from turnloom.operators.order import with_index

        return with_index(lines.where(F.trim("value") != ""), "pos", name="k").select("k", F.col("value").alias(name))

    both = used(left, "left").join(used(right, "right"), "k", "full")
    both = both.withColumn("same", F.assert_true(F.col("left").isNotNull() & F.col("right").isNotNull(), "the files differ in length"))
    return both.where("same is null").select(F.col("k").alias("pos"), "left", "right")


def parsed_filespec(lines: list[str]) -> list[tuple[str, str, str, float]]:
    """(file, destination, ranges, weight) of ``file train|dev|test ranges [weight w]``."""
    out = []
    for k, line in enumerate(lines, 1):
        parts = line.split()
        if not parts:
            continue
        if len(parts) not in (3, 5) or parts[1] not in ("train", "dev", "test") or parts[3:4] not in ([], ["weight"]):
            raise ValueError(f"line {k} is no file specification: {line}")
        out.append((parts[0], parts[1], parts[2], float(parts[4]) if len(parts) == 5 else 1.0))
    return out


def specified(spark: SparkSession, spec: list[str]) -> DataFrame:
    """file, split, pos, value, weight of the lines that a file specification takes, of all its files."""
    out = spark.createDataFrame([], "file int, split string, pos bigint, value string, weight double")
    for k, (path, split, ranges, weight) in enumerate(parsed_filespec(spec)):
        rows = file_ranges(numbered(spark, path), ranges)
        out = out.unionByName(rows.select(F.lit(k).alias("file"), F.lit(split).alias("split"), "pos", "value", F.lit(weight).alias("weight")))
    return out


def proposals(spark: SparkSession, paths: list[str], total: int, implicit: bool = True) -> DataFrame:
    """k, log_q, feature, value of the first ``total`` proposals of a list of files, begun again when they end.

    A line has a log-probability and its features, each with a value unless they are implicit."""
    lines = spark.createDataFrame([], "file int, pos bigint, value string")
    for k, path in enumerate(paths):
        lines = lines.unionByName(numbered(spark, path).select(F.lit(k).alias("file"), "pos", "value"))
    from turnloom.operators.order import with_index

    at = with_index(lines.where(F.trim("value") != ""), "file", "pos", name="k")
    n = at.agg(F.count("*").alias("n"))
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(total) - 1 - F.col("k")) / F.col("n")))
    taken = at.crossJoin(F.broadcast(n)).where(F.col("k") < total)  # one row
    taken = taken.withColumn("r", F.explode(rounds)).select((F.col("r") * F.col("n") + F.col("k")).alias("k"), "value")
    w = F.filter(F.split("value", "[ \t]+"), lambda x: x != "")
    parts = taken.select("k", F.get(w, F.lit(0)).cast("double").alias("log_q"), F.slice(w, F.lit(2), F.size(w)).alias("f"))
    if implicit:
        return parts.select("k", "log_q", F.explode("f").alias("feature"), F.lit(1.0).alias("value"))
    odd = F.assert_true(F.size("f") % 2 == 0, "a feature has no value")
    pairs = F.transform(F.filter("f", lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("feature"), F.get("f", 2 * i + 1).cast("double").alias("value")))
    return parts.withColumn("odd", odd).where("odd is null").select("k", "log_q", F.inline(pairs))
