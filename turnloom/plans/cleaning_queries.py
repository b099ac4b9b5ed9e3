"""Queries: transcript cleaning, writers, and order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import cleaning as C
from turnloom.operators import order as O
from turnloom.operators.features import window_features
from turnloom.plans.feature_queries import window_sql
from turnloom.plans.registry import query
from turnloom.sources.text_files import through_a_file
from turnloom.sources.units import RAW_SQL, key_sql, raw_lines, table, unit_key, units, with_units

PARSED = r"""parsed as (
  select lineno, nullif(regexp_extract(trim(value), '^([0-9]+),[0-9]+,', 1), '') as dyad, regexp_replace(trim(value), '^[0-9]+,[0-9]+,', '') as rest,
    case when regexp_matches(trim(value), '^[0-9]+,[0-9]+,') then null else 'm1' end as reason from raw
)"""
SPOKEN = r"""named as (
  select lineno, dyad, case when regexp_matches(rest, '(?i)^(gr|wi)[^,]+,') then case lower(rest[1]) when 'g' then 'Grocery' else 'Wine' end end as own,
    replace(regexp_replace(rest, '(?i)^(gr|wi)[^,]+,', ''), '-', '') as body
  from parsed where reason is null and (regexp_matches(rest, '(?i)^(gr|wi)[^,]+,') or not regexp_matches(rest, '^(Name|Group|Date)'))
), cut as (
  select *, string_split_regex(body, 'Grocery,|Wine,') as pieces from named
), kinds as (
  select *, case when length(body) < 10 or len(pieces) = 1 or (len(pieces) = 2 and (length(pieces[1]) < 10 or length(pieces[2]) < 10)) then 'whole' when len(pieces) = 2 then 'cut' else 'm3' end as kind from cut
), carried as (
  select *, coalesce(own, last(case kind when 'cut' then 'Wine' when 'whole' then own end ignore nulls) over (partition by dyad order by lineno rows between unbounded preceding and 1 preceding)) as speaker from kinds
), spoken as (
  select lineno, 0 as part, dyad, speaker, case kind when 'cut' then pieces[1] else body end as body, case when speaker is null then 'm2' when kind = 'm3' then 'm3' end as reason from carried
  union all select lineno, 1, dyad, 'Wine', pieces[2], case when speaker is null then 'm2' end from carried where kind = 'cut'
)"""
CODED = rf"""found as (
  select *, list_transform(regexp_extract_all(body, '\b({C.TAGS})\b', 1), lambda t: replace(replace(upper(t), ' ', ''), 'P!', 'P1')) as tags,
    list_filter(list_transform(string_split(regexp_replace(body, '\b({C.TAGS})\b', '', 'g'), '/'), lambda x: trim(x)), lambda x: regexp_matches(x, '[a-zA-Z0-9?]')) as pieces
  from spoken where reason is null
), tagged as (
  select *, case when list_contains(tags, 'PM') and len(tags) > 1 and not list_contains(tags, 'QR') then list_filter(tags, lambda t: t <> 'PM') else tags end as codes from found
), coded as (
  select *, case when len(pieces) = len(codes) or len(pieces) = 0 then pieces else string_split(list_reduce(pieces,
    lambda acc, x: acc || case when regexp_matches(acc, '[a-zA-Z0-9]$') then '/' else chr(1) end || x), chr(1)) end as units from tagged
)"""
TURNS = """runs as (
  select *, sum(fresh) over (partition by dyad order by lineno, part) as turn from (
    select *, case when lag(speaker) over (partition by dyad order by lineno, part) = speaker then 0 else 1 end as fresh from coded)
), turns as (
  select dyad, turn, speaker, min(lineno) as lineno, flatten(list(codes order by lineno, part)) as codes, flatten(list(units order by lineno, part)) as units from runs group by dyad, turn, speaker
)"""


def raw_sql(body: str, *ctes: str) -> str:
    return "with " + ", ".join([RAW_SQL, *ctes]) + "\n" + body


def _spoken(spark, d):
    return C.resolve_speakers(C.parse_dyads(raw_lines(spark, d)))


@query("raw_dyad_parse", raw_sql("select * from parsed", PARSED))
def raw_dyad_parse(spark, d):
    return C.parse_dyads(raw_lines(spark, d))


@query("resolve_speaker", raw_sql("select lineno, part, dyad, speaker, reason, md5(body) as body from spoken", PARSED, SPOKEN))
def resolve_speaker(spark, d):
    return _spoken(spark, d).select("lineno", "part", "dyad", "speaker", "reason", F.md5("body").alias("body"))


@query("extract_codes", raw_sql("select lineno, array_to_string(codes, ' ') as codes from coded", PARSED, SPOKEN, CODED))
def extract_codes(spark, d):
    return C.coded(_spoken(spark, d)).select("lineno", F.array_join("codes", " ").alias("codes"))


@query("segment_units", raw_sql("select lineno, array_to_string(units, chr(10)) as units from coded", PARSED, SPOKEN, CODED))
def segment_units(spark, d):
    return C.coded(_spoken(spark, d)).select("lineno", F.array_join("units", "\n").alias("units"))


@query("merge_turns", raw_sql("select dyad, cast(turn as bigint) as turn, speaker, lineno, cast(len(units) as integer) as n_units from turns", PARSED, SPOKEN, CODED, TURNS))
def merge_turns(spark, d):
    return C.merged_turns(_spoken(spark, d)).select("dyad", "turn", "speaker", "lineno", F.size("units").alias("n_units"))


@query(
    "align_units",
    raw_sql("select dyad, cast(turn as bigint) as turn, speaker, cast(k as integer) as k, units[k + 1] as unit, codes[k + 1] as code from (select *, unnest(range(len(units))) as k from turns where len(units) = len(codes))", PARSED, SPOKEN, CODED, TURNS),
)
def align_units(spark, d):
    return C.aligned(C.merged_turns(_spoken(spark, d)))


@query(
    "rejects",
    raw_sql(
        "select lineno, reason from parsed where reason is not null union all select lineno, reason from spoken where reason is not null and part = 0 union all select lineno, 'm4' from turns where len(units) <> len(codes)",
        PARSED, SPOKEN, CODED, TURNS,
    ),
)
def rejects(spark, d):
    parsed = C.parse_dyads(raw_lines(spark, d))
    spoken = C.resolve_speakers(parsed)
    return C.rejects(parsed, spoken, C.merged_turns(spoken))


@query("drop_dyads", with_units("select dyad, pos, unit from u where dyad not in ('36', '41', '74')"))
def drop_dyads(spark, d):
    return units(spark, d).where(~F.col("dyad").isin("36", "41", "74")).select("dyad", "pos", "unit")


@query("lower_unit", with_units("select dyad, pos, lower(unit) as unit from u"))
def lower_unit(spark, d):
    return units(spark, d).select("dyad", "pos", F.lower("unit").alias("unit"))


# question marks and legacy quotes are put in, as the turns have none
_BROKEN = "replace(replace(replace(lower(unit), '. s', '?s'), ' r', '?re '), ' im', ' “im…')"


@query(
    "char_subst",
    with_units(
        rf"select dyad, pos, regexp_replace(translate(regexp_replace(replace(regexp_replace(regexp_replace({_BROKEN}, '\?(re|ll|ve)', chr(1) || '\1', 'g'), '\?([std])([^a-z]|$)', chr(1) || '\1\2', 'g'), '?', '? '), '\? ([^a-z]|$)', '?\1', 'g'), "
        rf"'’…{X.DROPPED}', chr(39) || ' '), '(^|[^0-9A-Za-z_])im($|[^0-9A-Za-z_])', '\1i''m\2', 'g') as x from u"
    ).replace("select dyad, pos, regexp_replace(translate(", "select dyad, pos, replace(regexp_replace(translate(").replace("'g') as x from u", "'g'), chr(1), chr(39)) as unit from u"),
)
def char_subst(spark, d):
    broken = F.replace(F.replace(F.replace(F.lower("unit"), F.lit(". s"), F.lit("?s")), F.lit(" r"), F.lit("?re ")), F.lit(" im"), F.lit(" “im…"))
    return units(spark, d).select("dyad", "pos", X.substitute_characters(broken).alias("unit"))


@query("strip_comma", with_units(r"select dyad, pos, regexp_replace(regexp_replace(', ,' || unit || ' ,,', '^[,\s]+', ''), '[,\s]+$', '') as unit from u"))
def strip_comma(spark, d):
    return units(spark, d).select("dyad", "pos", X.strip_commas(F.concat(F.lit(", ,"), F.col("unit"), F.lit(" ,,"))).alias("unit"))


_PUNCT = r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


@query(
    "tokenize_fix",
    with_units(
        rf"select dyad, pos, array_to_string(list_transform(toks, lambda t: case when regexp_matches(regexp_replace(f(t), '{_PUNCT}', '', 'g'), '^[0-9]*$') then f(t) else regexp_replace(replace(f(t), ',', ' , '), '\.\.\.', ' ... ', 'g') end), ' ') as unit from u"
    ).replace("f(t)", r"regexp_replace(regexp_replace(t, ',,+', ',', 'g'), '\.\.+', '...', 'g')"),
)
def tokenize_fix(spark, d):
    return units(spark, d).select("dyad", "pos", F.array_join(F.transform("toks", X.fix_punct), " ").alias("unit"))


@query("tokenize_tb")
def tokenize_tb(spark, d):
    return units(spark, d).select("dyad", "pos", F.array_join(X.treebank_tokens(F.col("unit")), " ").alias("unit"))


_TRIPLED = "list_filter(t, lambda x, i: not (coalesce(t[i + 1], '') = x and coalesce(t[i + 2], '') = x))"
_T3 = r"t3 as (select dyad, pos, list_filter(string_split_regex(replace(unit || ' a a a a b_b', '_', ''), '[ \t\n\r\f\x0b]+'), lambda x: x <> '') as t from u)"


@query("remove_triples", with_units(f"select dyad, pos, array_to_string({_TRIPLED}, ' ') as unit from t3", _T3))
def remove_triples(spark, d):
    return units(spark, d).select("dyad", "pos", X.remove_triples(F.concat("unit", F.lit(" a a a a b_b"))).alias("unit"))


@query("has_triple", with_units(f"select dyad, pos, len({_TRIPLED}) < len(t) as triple from t3x", "t3x as (select dyad, pos, case when pos % 2 = 0 then toks || ['a', 'a', 'a'] else toks end as t from u)"))
def has_triple(spark, d):
    t = F.when(F.col("pos") % 2 == 0, F.concat("toks", F.array(*[F.lit("a")] * 3))).otherwise(F.col("toks"))
    return units(spark, d).select("dyad", "pos", X.has_triple(t).alias("triple"))


@query(
    "split_greedy",
    with_units(
        "select dyad, n, case when c - n < 0.6 * t then 'train' when c - n - e1 < 0.2 * t then 'dev' when c - n - e2 < 0.2 * t then 'test' end as split from q, x2",
        "s as (select dyad, count(*) as n, md5(dyad) as o from u group by dyad)",
        "q as (select *, sum(n) over (order by o, dyad) as c, sum(n) over () as t from s)",
        "x1 as (select min(c) as e1 from q where c >= 0.6 * t)",
        "x2 as (select e1, min(c) as e2 from q, x1 where c - e1 >= 0.2 * t group by e1)",
    ),
)
def split_greedy(spark, d):
    sizes = units(spark, d).groupBy("dyad").agg(F.count("*").alias("n")).withColumn("o", F.md5("dyad"))
    return O.greedy_split(sizes, (0.6, 0.2, 0.2), "dyad")


@query(
    "group_consecutive",
    with_units(
        "select dyad, run, min(pos) as first_pos, count(*) as n, any_value(role) as role from (select *, cast(sum(fresh) over (partition by dyad order by pos) as bigint) as run from f) group by dyad, run",
        "f as (select *, case when lag(role) over w = role then 0 else 1 end as fresh from u window w as (partition by dyad order by pos))",
    ),
)
def group_consecutive(spark, d):
    r = O.runs(units(spark, d), "dyad", "pos", "role")
    return r.groupBy("dyad", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.first("role").alias("role"))


@query("scan_numbered", "select row_number() over (order by conv_id, turn) as lineno, md5(coalesce(text, '')) as value from conversations")
def scan_numbered(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("value"))
    return O.with_index(c, "conv_id", "turn").select((F.col("idx") + 1).alias("lineno"), "value")


_TSV = "concat_ws(chr(9), dyad, '_', role, code, regexp_replace(unit, '[\\t\\n]', ' ', 'g'))"


def _tsv(u):
    return u.select("dyad", "pos", F.concat_ws("\t", "dyad", F.lit("_"), "role", "code", F.regexp_replace("unit", "[\t\n]", " ")).alias("line"))


def in_lines(lines: str) -> str:
    """SQL of lines (dyad, pos, line) numbered as in a file in the order of units."""
    return f"select row_number() over (order by {key_sql('dyad', 'pos')}) as pos, line as value from ({lines})"


def in_a_file(rows, tag: str):
    """(dyad, pos, line) written as a text file in the order of units, and scanned."""
    keyed = rows.select(unit_key(F.col("dyad"), F.col("pos")).alias("key"), F.col("line").alias("value"))
    return through_a_file(keyed, tag, "key")


@query("sink_dyads", with_units(in_lines(f"select dyad, pos, {_TSV} as line from u")))
def sink_dyads(spark, d):
    return in_a_file(_tsv(units(spark, d)), "dyads")


@query(
    "scan_dyads",
    with_units(f"select f[1] as dyad, f[3] as role, f[4] as code, f[5] as unit from (select string_split(trim({_TSV}), chr(9)) as f from u) where len(f) = 5"),
)
def scan_dyads(spark, d):
    f = _tsv(units(spark, d)).select(F.split(F.trim("line"), "\t", -1).alias("f")).where(F.size("f") == 5)
    return f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in ((0, "dyad"), (2, "role"), (3, "code"), (4, "unit"))])


@query("sink_partitioned", with_units("select dyad, count(*) as n from u group by dyad"))
def sink_partitioned(spark, d):
    """One folder per dyad, read back."""
    import uuid

    from turnloom.sources.shared import shared_dir

    path = f"{shared_dir(spark)}/turnloom/dyads-{uuid.uuid4().hex}"
    units(spark, d).select("dyad", "pos", "role", "code", "unit").repartition("dyad").write.partitionBy("dyad").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("dyad").cast("string").alias("dyad")).agg(F.count("*").alias("n"))


@query("project_unit", with_units("select unit from u"))
def project_unit(spark, d):
    return units(spark, d).select("unit")


@query(
    "write_features",
    in_lines(f"select dyad, pos, code || chr(9) || array_to_string(list_transform(string_split(feats, chr(9)), lambda f: 'F_' || f), chr(9)) as line from ({window_sql(1, 1)})"),
)
def write_features(spark, d):
    f = window_features(units(spark, d))
    lines = f.select("dyad", "pos", F.concat_ws("\t", "code", F.array_join(F.transform(F.split("feats", "\t"), lambda x: F.concat(F.lit("F_"), F.regexp_replace(x, r"\s", "_"))), "\t")).alias("line"))
    return in_a_file(lines, "features")


@query(
    "write_crf_items",
    in_lines(
        f"select dyad, pos, code || chr(9) || array_to_string(list_transform(string_split(feats, chr(9)), lambda f: 'F_' || replace(f, ':', '\\:')), chr(9)) as line from ({window_sql(1, 1)}) "
        "union all select cast(conv_id as varchar), max(turn) + 1, '' from conversations group by conv_id"
    ),
)
def write_crf_items(spark, d):
    """Items with escaped colons; an empty line ends each dyad."""
    f = window_features(units(spark, d))
    line = F.concat_ws("\t", "code", F.array_join(F.transform(F.split("feats", "\t"), lambda x: F.replace(F.concat(F.lit("F_"), F.regexp_replace(x, r"\s", "_")), F.lit(":"), F.lit("\\:"))), "\t"))
    ends = units(spark, d).groupBy("dyad").agg((F.max("pos") + 1).alias("pos")).withColumn("line", F.lit(""))
    return in_a_file(f.select("dyad", "pos", line.alias("line")).unionByName(ends), "items")


@query(
    "cfg_rules",
    with_units(
        "select distinct rule from (select 'S --> SENT' as rule union all select '0 1 WORDS --> WORD' union all select '0 1 WORDS --> WORDS WORD' union all select 'TOPIC_' || i || ' --> WORDS' from range(3) t(i) "
        "union all select '0 1 SENT --> DOC_' || dyad from u union all select '0 1 DOC_' || dyad || ' --> <s>' from u union all select '0 1 DOC_' || dyad || ' --> DOC_' || dyad || ' TOPIC_' || i from u, range(3) t(i) "
        "union all select '0 1 WORD --> ' || w from (select unnest(toks) as w from u))"
    ).replace("'S --> SENT'", "'0 1 S --> SENT'"),
)
def cfg_rules(spark, d):
    """Topic-collocation grammar over dyads as documents; each rule once."""
    from turnloom.operators.grammar import topic_rules

    return topic_rules(units(spark, d), 3)
