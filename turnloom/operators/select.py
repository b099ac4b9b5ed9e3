"""Feature construction and selection that needs more than counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel_map(vectors: DataFrame, n: int, seed: int = 1, sample: int = 500) -> DataFrame:
    """(vec_id, k, value): projections on ``n`` orthogonal directions between distant pairs.

    Pairs come from a bounded sample by hash; all vectors are projected."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample).select("embedding").collect()
    pool = np.array([r.embedding for r in rows], float)
    rng, basis = np.random.default_rng(seed), []
    while len(basis) < n and len(pool) and np.abs(pool - pool[0]).max() > 1e-9:
        i = int(rng.integers(len(pool)))
        d = pool[int(((pool - pool[i]) ** 2).sum(1).argmax())] - pool[i]
        basis.append(d / np.linalg.norm(d))
        pool = pool - np.outer(pool @ basis[-1], basis[-1])  # what is left is orthogonal to all directions so far
    if not basis:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, k int, value double")
    m = np.stack(basis)

    def run(batches):
        for b in batches:
            v = np.stack(b["embedding"].to_numpy()).astype(float) @ m.T
            yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), len(m)), "k": np.tile(np.arange(len(m)), len(b)), "value": v.reshape(-1)})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, k int, value double")


def greedy_features(long: DataFrame, gold: DataFrame, rounds: int, per_round: int) -> DataFrame:
    """(round, f, gain): binary features added by the gain of one Newton step at the present scores.

    A round is one aggregation of slopes and curvatures by feature; few rows reach the driver."""
    spark = long.sparkSession
    state = gold.select("rid", "label", F.lit(0.0).alias("s"))
    chosen: list[tuple[int, str, float]] = []
    for r in range(rounds):
        p = 1 / (1 + F.exp(-F.col("s")))
        at = state.select("rid", (F.col("label") - p).alias("d"), (p * (1 - p)).alias("h"))
        sums = long.join(at, "rid").groupBy("f").agg(F.sum("d").alias("d"), F.sum("h").alias("h"))
        sums = sums.where(~F.col("f").isin([f for _, f, _ in chosen])) if chosen else sums
        top = sums.select("f", (F.col("d") * F.col("d") / (2 * (F.col("h") + 1))).alias("gain"), (F.col("d") / (F.col("h") + 1)).alias("w")).orderBy(F.desc("gain"), "f").limit(per_round).collect()
        chosen += [(r, t.f, float(t.gain)) for t in top]
        w = spark.createDataFrame([(t.f, float(t.w)) for t in top], "f string, w double")
        add = long.join(F.broadcast(w), "f").groupBy("rid").agg(F.sum("w").alias("w"))  # per_round rows
        state = state.join(add, "rid", "left").select("rid", "label", (F.col("s") + F.coalesce("w", F.lit(0.0))).alias("s"))
    return spark.createDataFrame(chosen, "round int, f string, gain double")
