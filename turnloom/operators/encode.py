"""Feature dictionaries, encodings and filters over (rid, label, split, feats)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.order import with_index
from turnloom.sources.units import key_sql, unit_key, units

#: Features of a dictionary, and their characters, up to which rows look them up where they are; larger ones are joined.
LOOKED_UP, LOOKED_UP_CHARS = 1 << 20, 1 << 24
#: Codes of the synthetic labels, by label id.
CODES = ("IP", "IR", "SF", "MU")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, label, split, feats of all units: speaker and words."""
    u = units(spark, sf_dir)
    rid = unit_key(F.col("dyad"), F.col("pos"))
    label = (F.array_position(F.array(*map(F.lit, CODES)), F.col("code")) - 1).cast("int")
    feats = F.sort_array(F.array_distinct(F.concat(F.array(F.concat(F.lit("SPEAKER_"), F.col("role"))), F.transform("toks", lambda x: F.concat(F.lit("CUR_"), x)))))
    bucket = F.col("rid") % 10
    out = u.select(rid.alias("rid"), label.alias("label"), feats.alias("feats"))
    return out.withColumn("split", F.when(bucket < 6, "train").when(bucket < 8, "dev").otherwise("test"))


INSTANCES_SQL = f"""x0 as (
  select {key_sql('dyad', 'pos')} as rid, list_position(['IP', 'IR', 'SF', 'MU'], code) - 1 as label,
    list_sort(list_distinct(['SPEAKER_' || role] || list_transform(toks, lambda x: 'CUR_' || x))) as feats from u
), x as (
  select *, case when rid % 10 < 6 then 'train' when rid % 10 < 8 then 'dev' else 'test' end as split from x0
), l as (
  select rid, label, split, unnest(feats) as f from x
)"""


def long_form(rows: DataFrame) -> DataFrame:
    return rows.select("rid", "label", "split", F.explode("feats").alias("f"))


def dictionary(rows: DataFrame) -> DataFrame:
    """(f, id) of training features by first appearance, after the bias with id 0."""
    return _numbered(long_form(rows.where("split = 'train'")).groupBy("f").agg(F.min("rid").alias("first")))


def _numbered(first: DataFrame) -> DataFrame:
    ids = with_index(first, "first", "f", name="id").select("f", (F.col("id") + 1).alias("id"))
    bias = first.sparkSession.createDataFrame([("**BIAS**", 0)], "f string, id bigint")
    return bias.unionByName(ids)


DICTIONARY_SQL = "dict as (select '**BIAS**' as f, 0 as id union all select f, row_number() over (order by first, f) from (select f, min(rid) as first from l where split = 'train' group by f))"


def encode(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, split, label, id): unknown features drop out, each row has the bias."""
    known = long_form(rows).join(ids, "f").select("rid", "split", "label", "id")
    return known.unionByName(rows.select("rid", "split", "label", F.lit(0).cast("long").alias("id")))


def sized(ids: DataFrame) -> tuple[int, bool]:
    """Features of a dictionary, and whether rows look them up."""
    n, chars = ids.agg(F.count("*"), F.coalesce(F.sum(F.length("f")), F.lit(0))).first()
    return n, n <= LOOKED_UP and chars <= LOOKED_UP_CHARS


def looked_up(rows: DataFrame, ids: DataFrame, bias: bool) -> DataFrame:
    """Rows with ``ids``, sorted, for their ``feats``; the dictionary's ids have no gaps.  With a ``bias`` each row has 0 too."""
    known = [r.f for r in ids.select("f", "id").orderBy("id").collect()]  # within the bounds above
    shared = rows.sparkSession.sparkContext.broadcast(known)
    keys = [x for x in rows.schema if x.name != "feats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        for b in batches:
            lists, n = b.column(len(names)), b.num_rows
            found = pc.index_in(lists.flatten().cast(pa.string()), value_set=words)
            at = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[found.is_valid().to_numpy(zero_copy_only=False)]
            own = found.drop_null().to_numpy().astype(np.int64)
            if bias:
                at, own = np.concatenate((np.arange(n), at)), np.concatenate((np.zeros(n, np.int64), own))
            bounds = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(bounds, own[np.lexsort((own, at))])], [*names, "ids"])

    names = [x.name for x in keys]
    return rows.select(*names, "feats").mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in keys) + ", ids array<bigint>")


def packed(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """(rid, split, label, ids) of rows encoded, ids sorted, and the features of the dictionary."""
    n, few = sized(ids)
    rows = rows.select("rid", "split", "label", "feats")
    if few:
        each = looked_up(rows, ids, bias=True)
        return each.groupBy("rid", "split", "label").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")), n
    return encode(rows, ids).groupBy("rid", "split", "label").agg(F.sort_array(F.collect_list("id")).alias("ids")), n


def frequent_dictionary(rows: DataFrame, least: int) -> DataFrame:
    """The dictionary of the features that occur at least ``least`` times, without cutting them from the rows first."""
    first = F.min(F.when(F.col("split") == "train", F.col("rid")))
    seen = long_form(rows).groupBy("f").agg(F.count("*").alias("n"), first.alias("first")).where((F.col("n") >= least) & F.col("first").isNotNull())
    return _numbered(seen.select("f", "first"))


def frequent_only(rows: DataFrame, least: int, documents: bool = False) -> DataFrame:
    """Rows with the features that occur at least ``least`` times (in different rows, on request)."""
    occurrences = rows.select("rid", F.explode("feats").alias("f"))
    n = F.countDistinct("rid") if documents else F.count("*")
    keep = occurrences.groupBy("f").agg(n.alias("n")).where(F.col("n") >= least).select("f")
    kept = occurrences.join(keep, "f", "left_semi").groupBy("rid").agg(F.sort_array(F.collect_list("f")).alias("feats"))
    return rows.drop("feats").join(kept, "rid", "left").withColumn("feats", F.coalesce("feats", F.array().cast("array<string>")))
