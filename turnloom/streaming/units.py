"""Unit cleaning and scoring on streams: the stateless operators run unchanged.

Grouping by consecutive key needs state, one row a dyad; windows of neighbours need later rows and
stay in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.functions import text as X


def unit_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Turns arriving as Parquet files of the conversations' schema, cleaned and tokenised."""
    raw = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    unit = X.strip_commas(X.repair_characters(F.lower(F.coalesce("text", F.lit("")))))
    return raw.select(F.col("conv_id").cast("string").alias("dyad"), F.col("turn").alias("pos"), "role", unit.alias("unit")).withColumn("toks", X.tokens(F.col("unit")))


def turn_runs(units: DataFrame) -> DataFrame:
    """Closed runs of one speaker per dyad, as they end; the open run is the state."""

    def step(key, batches, state: GroupState):
        who, first, n = state.get if state.exists else (None, 0, 0)
        done = []
        rows = pd.concat(list(batches)).sort_values("pos")
        for role, pos in zip(rows["role"], rows["pos"], strict=True):
            if role != who:
                if who is not None:
                    done.append((key[0], who, first, n))
                who, first, n = role, int(pos), 0
            n += 1
        state.update((who, first, n))
        yield pd.DataFrame(done, columns=["dyad", "role", "first_pos", "n"])

    return units.select("dyad", "pos", "role").groupBy("dyad").applyInPandasWithState(step, "dyad string, role string, first_pos bigint, n bigint", "role string, first_pos bigint, n bigint", "append", GroupStateTimeout.NoTimeout)
