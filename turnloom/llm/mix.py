"""Mixing sources to target weights with hash-threshold histograms.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of the
whole corpus.  A target stops at ``max_epochs`` times its source's words; the excess goes to the
others by weight.  A source is then taken ``floor(target / words)`` times in whole, and the rest
of its target is met by the documents whose hash lies under a threshold.  The threshold comes from
a histogram of words by source and hash bucket: the bucket that holds the boundary, and only it,
is cut into finer buckets until one hash is left.  Nothing is sorted by document.

Edge cases: null text has size 0; a null source is a source, the last; a null doc_id hashes as
empty; rows equal in doc_id and text share a hash and are taken together; sources without words
and empty tables take nothing; other columns are not read.  Ties: of the two sums of words next
to the target the lower is taken if both are as near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.store import by_input, materialize, release, unused
from turnloom.llm.words import word_count

HASH_BITS = 60
LEVEL_BITS = 12


def text_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a row's id and text; the same in every run and engine."""
    joined = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(totals: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 in code-point order: ranges first, then places within each range."""
    parts = materialize(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("place", place).join(counts.select("part", before.alias("before")), "part").select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("rank"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Each round caps the sources whose share is too large and shares again what is left; only
    three sums reach the driver.  The capped set only grows, so the rounds end.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(totals).withColumn("weight", weight.cast("long")), "weights")
    cap = F.col("source_size") * max_epochs
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, among = total or 0, all_weight or 1
    capped, seen = F.lit(False), 0
    while rest:
        over = cap.cast("decimal(38,0)") * among < F.lit(rest).cast("decimal(38,0)") * F.col("weight")
        capped = over
        n, kept, off = ranked.where(over).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == seen:
            break
        seen, rest, among = n, total - kept, all_weight - off
    share = (F.lit(rest).cast("long") * F.col("weight")).cast("double") / F.lit(among).cast("double")
    return ranked.select("source", "source_size", F.round(F.when(capped, cap.cast("double")).otherwise(share), 6).alias("target"), F.when(capped, cap.cast("double")).otherwise(share).alias("exact"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``copies`` (whole takes) and ``cut`` (one more take for hashes below it) to targets.

    ``sized``: (source, size, hash), materialised by the caller.
    """
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("exact") / size)).otherwise(0).cast("long")
    plan = targets.withColumn("copies", copies).withColumn("rest", F.col("exact") - F.col("copies") * size)
    settled = [plan.where("rest <= 0").select("source", F.lit(0).cast("long").alias("cut"))]
    state = plan.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    rows, old = sized, []
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        key = F.shiftright(F.col("hash"), shift)
        s = state.select(F.col("source").alias("s"), "rest", "prefix")
        mine = rows.join(s, rows["source"].eqNullSafe(s["s"]) & (F.shiftright(rows["hash"], shift + LEVEL_BITS) == s["prefix"])).select("source", "rest", "size", "hash", key.alias("bucket"))
        if level > 1:
            mine = materialize(mine, "boundary")
            old.append(mine)
        bars = mine.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        w = Window.partitionBy("source").orderBy("bucket")
        bars = bars.withColumn("upto", F.sum("words").over(w))
        edge = bars.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("words") > 0))
        edge = edge.withColumn("rest", F.col("rest") - (F.col("upto") - F.col("words")))
        edge = materialize(edge, "edge")
        old.append(edge)
        one = F.col("low") == F.col("high")
        nearer = F.col("words") - F.col("rest") < F.col("rest")
        settled.append(edge.where(one).select("source", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("cut")))
        state = edge.where(~one).select("source", "rest", F.col("bucket").alias("prefix"))
        rows = mine.select("source", "size", "hash")
        if state.isEmpty():
            break
    cuts = settled[0]
    for x in settled[1:]:
        cuts = cuts.unionByName(x)
    cuts = cuts.select(F.col("source").alias("s"), "cut")
    out = materialize(plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").select("source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")), "plan")
    release(*old)
    return out


def mixture(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of all documents, and the plan of every source."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    sized = materialize(by_input(sized, docs), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, source_targets(totals))


def takes() -> Column:
    return F.col("copies") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each, and its source's target."""
    sized, plan = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = plan.withColumnRenamed("source", "s")
    return sized.join(plan, sized["source"].eqNullSafe(plan["s"]), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * takes()).cast("long").alias("taken"))


def mix_stage(docs: DataFrame) -> DataFrame:
    """Documents repeated as often as the mix takes them, with their own columns only.

    Decisions join by source alone, so texts are not shuffled while the plan is small."""
    sized, plan = mixture(docs)
    release(sized)
    s, copies, cut, k = (unused(docs, x) for x in ("s", "copies", "cut", "k"))
    ours = plan.select(F.col("source").alias(s), F.col("copies").alias(copies), F.col("cut").alias(cut))
    n = F.col(copies) + F.when(text_hash(F.col("doc_id"), F.col("text")) < F.col(cut), 1).otherwise(0)
    out = docs.join(ours, docs["source"].eqNullSafe(ours[s]), "left")
    return by_input(out.withColumn(k, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*docs.columns), docs)


OP2_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as hash
  from documents
), totals as (
  select source, cast(sum(size) as bigint) as s, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from sized group by source
), ordered as (
  select *, coalesce(sum(3 * s) over o, 0) as caps, coalesce(sum(w) over o, 0) as off, sum(s) over () as t, sum(w) over () as ws
  from totals window o as (order by 3.0 * s / w, source nulls last rows between unbounded preceding and 1 preceding)
), first_free as (
  select cast(t - caps as bigint) as rest, cast(ws - off as bigint) as among from ordered
  where cast(3 * s as hugeint) * (ws - off) >= (t - caps) * w order by 3.0 * s / w, source nulls last limit 1
), targets as (
  select source, s, case when cast(3 * s as hugeint) * among < cast(rest as hugeint) * w then cast(3 * s as double)
    else cast(rest * w as double) / cast(among as double) end as target from totals, first_free
), plan as (
  select *, case when s > 0 then cast(floor(target / s) as bigint) else 0 end as copies from targets
), hashes as (
  select d.source, d.hash, sum(d.size) as words from sized d group by 1, 2
), upto as (
  select h.*, sum(words) over (partition by source order by hash) as c from hashes h
), picked as (
  select u.source, u.hash from upto u join plan p on u.source is not distinct from p.source
  where c <= p.target - copies * s or (c - words < p.target - copies * s and c - (p.target - copies * s) < (p.target - copies * s) - (c - words))
)
select d.doc_id, cast(d.size as bigint) as size, p.s as source_size, round(p.target, 6) as target,
  cast(d.size * (p.copies + case when k.hash is null then 0 else 1 end) as bigint) as taken
from sized d join plan p on d.source is not distinct from p.source
left join picked k on d.source is not distinct from k.source and d.hash = k.hash
"""
