"""Evaluation of predictions against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, k: int) -> DataFrame:
    """tag, correct, total for all tags of (ref, kbest) and one row ``Overall``; total is 0 for tags never in ref."""
    hit = F.array_contains(F.slice("kbest", 1, k), F.col("ref")).cast("long")
    per = rows.groupBy("ref").agg(F.sum(hit).alias("correct"), F.count("*").alias("total"))
    tags = rows.select(F.explode(F.slice("kbest", 1, k)).alias("ref")).union(rows.select("ref")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    by_tag = tags.join(per, "ref", "left").select(F.col("ref").cast("string").alias("tag"), zero("correct"), zero("total"))
    return by_tag.unionByName(rows.agg(F.lit("Overall").alias("tag"), F.coalesce(F.sum(hit), F.lit(0)).alias("correct"), F.count("*").alias("total")))


def curve(rows: DataFrame, most: int) -> DataFrame:
    """k, correct, total for every k up to ``most`` from the rank of the reference."""
    rank = F.array_position("kbest", F.col("ref"))
    return rows.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), rank.alias("r")).groupBy("k").agg(F.sum(F.when((F.col("r") > 0) & (F.col("r") <= F.col("k")), 1).otherwise(0)).alias("correct"), F.count("*").alias("total"))


def confusion(rows: DataFrame) -> DataFrame:
    """Long confusion matrix with row and column totals (null marks a total); no grand total."""
    cube = rows.cube("ref", "ans").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return cube.where("g < 3").select("ref", "ans", "n")


def confusion_table(rows: DataFrame, tags: list[str]) -> DataFrame:
    """One row a reference tag, a column an answer tag, and totals."""
    counts = rows.groupBy("ref").pivot("ans", tags).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(str(t)), F.lit(0)) for t in tags), F.lit(0).cast("long"))
    return counts.select("ref", *[F.col(str(t)).alias(f"to_{t}") for t in tags], total.alias("total"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def by_label(rows: DataFrame) -> DataFrame:
    """match, model, ref counts and precision, recall, F1 of each label seen in (ref, ans)."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("ref").alias("label"), F.lit(1).alias("r"), F.lit(0).alias("m"), (F.col("ref") == F.col("ans")).cast("int").alias("x")), F.struct(F.col("ans").alias("label"), F.lit(0).alias("r"), F.lit(1).alias("m"), F.lit(0).alias("x")))).alias("s")).select("s.*")
    n = sides.groupBy("label").agg(F.sum("x").alias("match"), F.sum("m").alias("model"), F.sum("r").alias("ref"))
    p, r = _ratio(F.col("match"), F.col("model")), _ratio(F.col("match"), F.col("ref"))
    return n.select("label", "match", "model", "ref", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def sequence_report(rows: DataFrame, n_labels: int) -> DataFrame:
    """One row: macro averages over all model labels, item and whole-sequence accuracy.

    Labels without a reference do not add to the sums."""
    labels = by_label(rows).where("ref > 0").agg(*[(F.sum(c) / n_labels).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    seqs = rows.groupBy("seq").agg(F.count("*").alias("n"), F.sum((F.col("ref") == F.col("ans")).cast("int")).alias("k"))
    acc = seqs.agg(F.sum("k").alias("items_correct"), F.sum("n").alias("items"), F.sum((F.col("n") == F.col("k")).cast("int")).alias("sequences_correct"), F.count("*").alias("sequences"))
    return labels.crossJoin(F.broadcast(acc))  # one row each
