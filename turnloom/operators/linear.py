"""Linear scoring over long-form weights, and what is read off scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_feature(weights: DataFrame, classes: int) -> DataFrame:
    """(f, w array) from (f, c, w), an entry for each class."""
    return weights.groupBy("f").agg(F.array(*[F.coalesce(F.max(F.when(F.col("c") == k, F.col("w"))), F.lit(0.0)) for k in range(classes)]).alias("w"))


def totals(rows: DataFrame, long: DataFrame, weights: DataFrame, bias: list[float]) -> DataFrame:
    """(rid, s array): one row of sums for each of ``rows``.

    The join is over (rid, f) with (f, w array) and has a row a feature, not one a feature and class;
    the bias is a constant of each row, so no feature is in all of them.  Unknown features drop out."""
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(bias))]
    found = long.join(weights, "f").groupBy("rid").agg(*sums)
    at = rows.select("rid").join(found, "rid", "left")
    return at.select("rid", F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(float(b)) for k, b in enumerate(bias)]).alias("s"))


def long_scores(sums: DataFrame) -> DataFrame:
    """(rid, c, score) of (rid, s)."""
    return sums.select("rid", F.posexplode("s").alias("c", "score")).withColumn("c", F.col("c").cast("long"))


def shares(s: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def log_total(score: Column, keys: list[str]) -> Column:
    """Log-sum-exp within a row, shifted by the maximum."""
    w = Window.partitionBy(*keys)
    top = F.max(score).over(w)
    return F.log(F.sum(F.exp(score - top)).over(w)) + top


def softmax(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", F.exp(F.col("score") - log_total(F.col("score"), ["rid"])))


def ranked(scored: DataFrame) -> DataFrame:
    """(rid, kbest): labels by falling score, ties to the lower label."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "c")))
    return scored.groupBy("rid").agg(F.transform(order, lambda x: x["c"]).alias("kbest"))


def best(scored: DataFrame) -> DataFrame:
    """(rid, pred): first label of the highest score."""
    return scored.groupBy("rid").agg(F.min_by("c", F.struct(-F.col("score"), "c")).alias("pred"))


def pushes(sums: DataFrame, gold: DataFrame) -> DataFrame:
    """(rid, loss, d array): each row's negative log-likelihood, and its shares less the gold label's one."""
    both = sums.join(gold, "rid").withColumn("top", F.array_max("s"))
    z = F.log(F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, y: a + y)) + F.col("top")
    both = both.withColumn("z", z)
    d = F.transform("s", lambda x, i: F.exp(x - F.col("z")) - F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return both.select("rid", (F.col("z") - F.element_at("s", F.col("label") + 1)).alias("loss"), d.alias("d"))


def objective(push: DataFrame, weights: DataFrame, bias: list[float], ridge: float) -> DataFrame:
    """Negative log-likelihood plus half the ridge times the squared weights, one row."""
    size = weights.agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)).alias("q"))
    out = push.agg(F.sum("loss").alias("nll")).crossJoin(F.broadcast(size))  # one row each
    return out.select((F.col("nll") + ridge / 2 * (F.coalesce("q", F.lit(0.0)) + sum(b * b for b in bias))).alias("objective"))


def gradient(long: DataFrame, push: DataFrame, weights: DataFrame, bias: list[float], ridge: float) -> DataFrame:
    """(f, c, g): expected minus observed counts plus the ridge term; the bias is one sum over rows."""
    sums = [F.sum(F.col("d")[k]).alias(f"d{k}") for k in range(len(bias))]
    own = long.join(push.select("rid", "d"), "rid").groupBy("f").agg(*sums).join(weights, "f")
    wide = own.select("f", F.array(*[F.col(f"d{k}") + ridge * F.col("w")[k] for k in range(len(bias))]).alias("g"))
    of_bias = push.agg(*sums).select(F.lit("**BIAS**").alias("f"), F.array(*[F.col(f"d{k}") + ridge * b for k, b in enumerate(bias)]).alias("g"))
    return wide.unionByName(of_bias).select("f", F.posexplode("g").alias("c", "g")).withColumn("c", F.col("c").cast("long"))


def latent(parts: DataFrame) -> DataFrame:
    """(rid, c, p) from (rid, c, h, psi): hidden states are summed out, then rows normalised."""
    per = parts.groupBy("rid", "c").agg(F.max("psi").alias("top"), F.collect_list("psi").alias("all"))  # as many as hidden states
    s = F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))) + F.col("top")
    return softmax(per.select("rid", "c", s.alias("score"))).select("rid", "c", "p")


#: A rational approximation of the inverse error function, to about six digits.
MID = ((0.886226899, -1.645349621, 0.914624893, -0.140543331), (1.0, -2.118377725, 1.442710462, -0.329097515, 0.012229801))
TAIL = ((-1.970840454, -1.624906493, 3.429567803, 1.641345311), (1.0, 3.543889200, 1.637067800))


def _poly(x: Column, cs) -> Column:
    out = F.lit(float(cs[-1]))
    for c in reversed(cs[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1."""
    y = 2 * p - 1
    z = F.sqrt(-F.log((1 - F.abs(y)) / 2))
    mid = y * _poly(y * y, MID[0]) / _poly(y * y, MID[1])
    tail = F.signum(y) * _poly(z, TAIL[0]) / _poly(z, TAIL[1])
    return F.sqrt(F.lit(2.0)) * F.when(F.abs(y) <= 0.7, mid).otherwise(tail)


def bns(long: DataFrame, gold: DataFrame) -> DataFrame:
    """(f, bns): bi-normal separation of each feature over the classes, counts smoothed by a half."""
    classes = gold.groupBy("label").agg(F.count("*").alias("n_c"))
    total = gold.agg(F.count("*").alias("n"))
    by = long.select("rid", "f").distinct().join(gold, "rid")
    per_class = by.groupBy("f", "label").agg(F.count("*").alias("n_fc"))
    grid = per_class.groupBy("f").agg(F.sum("n_fc").alias("n_f")).crossJoin(F.broadcast(classes.crossJoin(total)))  # as many as labels
    full = grid.join(per_class, ["f", "label"], "left").withColumn("k", F.coalesce("n_fc", F.lit(0)))
    a = normal_quantile((F.col("k") + 0.5) / (F.col("n_c") + 1.0))
    b = normal_quantile((F.col("n_f") - F.col("k") + 0.5) / (F.col("n") - F.col("n_c") + 1.0))
    return full.groupBy("f").agg(F.sum(F.abs(a - b)).alias("bns"))
