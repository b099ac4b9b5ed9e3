"""Operators for which order carries meaning, without a single-task sort of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.sources.shared import written


def with_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Add a gapless index from 0 in the given order.

    The order is a range exchange; places are counted within ranges, and the ranges' sizes,
    one row a partition, are summed up."""
    parts = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    at = parts.withColumn("_place", place).join(sizes.select("_part", before.alias("_before")), "_part")
    return at.withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_part", "_place", "_before")


def running_sum(df: DataFrame, pos: str, value: Column, name: str, keys: tuple[str, ...] = (), block: int = 1 << 16) -> DataFrame:
    """Inclusive prefix sum of ``value`` along an integer position, block by block."""
    b = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(pos) / block))
    sums = b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    within = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(pos))
    return b.withColumn("_w", within).join(before, [*keys, "_b"]).withColumn(name, (F.col("_before") + F.col("_w")).cast("long")).drop("_v", "_b", "_w", "_before")


def first_seen_ids(df: DataFrame, key: str, pos: str, start: int = 0, name: str = "id") -> DataFrame:
    """(key, id): ids by first appearance.  Only distinct keys are ordered."""
    first = df.groupBy(key).agg(F.min(pos).alias("_first"))
    return with_index(first, "_first", key, name=name).select(key, (F.col(name) + start).alias(name))


def runs(df: DataFrame, part: str, pos: str, key: str, name: str = "run") -> DataFrame:
    """Number the runs of equal consecutive keys within a part, from 1."""
    w = Window.partitionBy(part).orderBy(pos)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def greedy_split(sizes: DataFrame, shares: tuple[float, float, float], doc: str = "doc", n: str = "n", order: str = "o") -> DataFrame:
    """Label whole documents train, dev or test by running line counts; a part overshoots by less than a document.

    ``sizes`` has one row per document; three sums reach the driver's plan as scalars in one row."""
    at = with_index(sizes, order, doc, name="k")
    at = running_sum(at, "k", F.col(n), "c")
    total = at.agg(F.sum(n).alias("t"))
    all_shares = sum(shares)
    tr, de, te = (s / all_shares for s in shares)
    q = at.crossJoin(F.broadcast(total))  # one row on the right
    e1 = q.agg(F.min(F.when(F.col("c") >= tr * F.col("t"), F.col("c"))).alias("e1"))
    q = q.crossJoin(F.broadcast(e1))
    e2 = q.agg(F.min(F.when(F.col("c") - F.col("e1") >= de * F.col("t"), F.col("c"))).alias("e2"))
    q = q.crossJoin(F.broadcast(e2))
    before = F.col("c") - F.col(n)
    part = F.when(before < tr * F.col("t"), "train").when(before - F.col("e1") < de * F.col("t"), "dev").when(before - F.col("e2") < te * F.col("t"), "test")
    return q.select(doc, n, part.alias("split"))
