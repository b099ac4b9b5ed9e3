"""The fact table of thought units, and the adapter from turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import tokens


#: Places below which turn numbers lie in a unit's key.
PLACES = 32


def unit_key(dyad: Column, pos: Column) -> Column:
    """One number for a unit, in the order of conversations and turns.

    Turn numbers are below 2^32 and conversation numbers below 2^31, as their types have it."""
    return F.shiftleft(dyad.cast("long"), PLACES) + pos.cast("long")


def key_parts(key: Column) -> tuple[Column, Column]:
    """Conversation and turn of a key."""
    return F.shiftright(key, PLACES), key.bitwiseAND(F.lit((1 << PLACES) - 1))


def key_sql(dyad: str, pos: str) -> str:
    return f"(cast({dyad} as bigint) * {1 << PLACES} + {pos})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dyad, pos, role, code, unit, toks of every conversation turn.

    Codes are synthetic: a bucket of the token count."""
    u = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("dyad"), F.col("turn").cast("long").alias("pos"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("unit")
    )
    u = u.withColumn("toks", tokens(F.col("unit")))
    n = F.size("toks")
    code = F.when(n <= 10, "IP").when(n <= 20, "IR").when(n <= 40, "SF").otherwise("MU")
    return u.select("dyad", "pos", "role", code.alias("code"), "unit", "toks")


def token_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dyad, pos, k, w, tag of every token of every turn.  Tags are synthetic: a word's form."""
    w = F.col("w")
    tag = F.when(w.rlike("^[0-9]"), "CD").when(w.rlike("^[A-Z]"), "NNP").when(w.rlike("[.,!?]$"), "PUN").when(F.length(w) <= 3, "FW").otherwise("NN")
    return units(spark, sf_dir).select("dyad", "pos", F.posexplode("toks").alias("k", "w")).withColumn("tag", tag)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineno and value: turns written as raw transcript lines, some without a prefix."""
    c = table(spark, sf_dir, "conversations")
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    who = F.when(F.col("role") == "user", "Grocery,").when(F.col("role") == "assistant", "wine,").otherwise("")
    line = F.concat(F.col("conv_id").cast("string"), F.lit(","), F.col("turn").cast("string"), F.lit(","), who, F.replace(t, F.lit(". "), F.lit(" / IR ")), F.lit(" / IP"))
    return c.select(unit_key(F.col("conv_id"), F.col("turn")).alias("lineno"), F.when(F.col("turn") % 7 == 5, F.concat(F.lit("bad "), t)).otherwise(line).alias("value"))


RAW_SQL = f"""raw as (
  select {key_sql('conv_id', 'turn')} as lineno, case when turn % 7 = 5 then 'bad ' || t else conv_id || ',' || turn || ',' || case role when 'user' then 'Grocery,' when 'assistant' then 'wine,' else '' end
    || replace(t, '. ', ' / IR ') || ' / IP' end as value
  from (select *, replace(coalesce(text, ''), chr(10), ' ') as t from conversations)
)"""

#: The same in DuckDB: a common table expression named ``u``.
UNITS_SQL = r"""u0 as (
  select cast(conv_id as varchar) as dyad, turn as pos, coalesce(role, '') as role, coalesce(text, '') as unit,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0b]+'), lambda x: x <> '') as toks from conversations
), u as (
  select *, case when len(toks) <= 10 then 'IP' when len(toks) <= 20 then 'IR' when len(toks) <= 40 then 'SF' else 'MU' end as code from u0
)"""


#: The same of every token: a table named ``tk``.
TOKENS_SQL = r"""tk as (
  select *, case when regexp_matches(w, '^[0-9]') then 'CD' when regexp_matches(w, '^[A-Z]') then 'NNP' when regexp_matches(w, '[.,!?]$') then 'PUN' when length(w) <= 3 then 'FW' else 'NN' end as tag
  from (select dyad, pos, cast(unnest(range(len(toks))) as integer) as k, unnest(toks) as w from u)
)"""


def with_units(body: str, *more: str) -> str:
    return "with " + ", ".join([UNITS_SQL, *more]) + "\n" + body
