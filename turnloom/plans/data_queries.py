"""Queries: text formats, dictionaries, encodings, lexicons and label handling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import text as X
from turnloom.operators import encode as E
from turnloom.operators import order as O
from turnloom.operators.lexicon import tag_tokens
from turnloom.plans.registry import query
from turnloom.sources import feature_text as T
from turnloom.sources.text_files import a_path, specified, through_a_file, write_lines
from turnloom.sources.units import TOKENS_SQL, key_parts, key_sql, table, token_items, unit_key, units, with_units


def xsql(body: str, *more: str) -> str:
    return with_units(body, E.INSTANCES_SQL, *more)


def of_unit(key: str):
    dyad, pos = key_parts(F.col(key))
    return dyad.cast("string").alias("dyad"), pos.alias("pos")


def lines_of(*rows: str):
    """The same literal lines as a text file for Spark, and for DuckDB."""
    values = ", ".join("({}, '{}')".format(i + 1, r.replace("'", "''")) for i, r in enumerate(rows))
    frame = lambda spark: spark.createDataFrame(list(enumerate(rows, 1)), "pos bigint, value string")
    return (lambda spark: through_a_file(frame(spark).coalesce(1), "literal", "pos")), f"lines(pos, value) as (select cast(i as bigint), v from (values {values}) t(i, v))"


SECTIONED = """sec as (
  select case split when 'train' then rid when 'dev' then 2305843009213693953 + rid else 4611686018427387905 + rid end as pos, label || ' ' || array_to_string(feats, ' ') as value from x
  union all select 2305843009213693952, 'DEV' union all select 4611686018427387904, 'TEST'
)"""


def sectioned(spark, d):
    x = E.instances(spark, d)
    dev, test = 1 << 61, 1 << 62  # lines of the marks, past all keys and past all keys after the first
    shift = F.when(F.col("split") == "train", F.lit(0)).when(F.col("split") == "dev", F.lit(dev + 1)).otherwise(F.lit(test + 1))
    body = x.select((F.col("rid") + shift).alias("pos"), F.concat(F.col("label").cast("string"), F.lit(" "), F.array_join("feats", " ")).alias("value"))
    return body.unionByName(spark.createDataFrame([(dev, "DEV"), (test, "TEST")], "pos bigint, value string"))


@query(
    "scan_sections",
    xsql(
        "select pos, case when pos > 4611686018427387904 then 'test' when pos > 2305843009213693952 then 'dev' else 'train' end as split, w[1] as label, array_to_string(list_sort(list_distinct(w[2:])), ' ') as feats "
        "from (select pos, list_filter(string_split_regex(value, '[ \\t]+'), lambda x: x <> '') as w from sec where value not in ('DEV', 'TEST'))",
        SECTIONED,
    ),
)
def scan_sections(spark, d):
    return T.binary_rows(T.sections(sectioned(spark, d))).select("pos", "split", "label", F.array_join("feats", " ").alias("feats"))


@query(
    "restore_text",
    xsql(f"select rid, label || chr(9) || array_to_string(list('F_' || f order by f), chr(9)) as line from e join inv using (id) group by rid, label", E.DICTIONARY_SQL, "e as (select rid, label, id from l join dict using (f))", "inv as (select id, f from dict)"),
)
def restore_text(spark, d):
    """Encoded rows turned back to text by the dictionary."""
    x = E.instances(spark, d)
    ids = E.dictionary(x)
    back = E.encode(x, ids).where("id > 0").join(ids, "id")
    return back.groupBy("rid", "label").agg(F.sort_array(F.collect_list("f")).alias("fs")).select("rid", F.concat_ws("\t", F.col("label").cast("string"), F.array_join(F.transform("fs", lambda x: F.concat(F.lit("F_"), x)), "\t")).alias("line"))


@query(
    "scan_real_feats",
    with_units("select dyad, pos, name, cast(arg_max(k, k) as double) as value from (select dyad, pos, unnest(toks) as name, unnest(range(1, len(toks) + 1)) as k from u) group by dyad, pos, name"),
)
def scan_real_feats(spark, d):
    u = units(spark, d)
    pos = unit_key(F.col("dyad"), F.col("pos"))
    line = F.concat(F.lit("0 "), F.array_join(F.transform("toks", lambda t, i: F.concat(t, F.lit(" "), (i + 1).cast("string"))), " "))
    rows = T.real_rows(u.where(F.size("toks") > 0).select(pos.alias("pos"), line.alias("value")))
    return rows.select(*of_unit("pos"), "name", "value")


def _valued_sql() -> str:
    return "with " + _VALUED_SQL + r""", w as (select pos, list_filter(string_split_regex(trim(regexp_replace(replace(value, '$$$OUTOFDOMAIN', ' '), '#.*$', '')), '\s+'), lambda x: x <> '') as w, contains(value, '$$$OUTOFDOMAIN') as ood from lines)
select pos, w[1] as label, w[2 * k] as name, cast(w[2 * k + 1] as double) as value from (select *, unnest(range(1, (len(w) - 1) // 2 + 1)) as k from w where len(w) > 0 and not ood)"""


_VALUED, _VALUED_SQL = lines_of("1 a 0.5 b 2 # note", "0 $$$OUTOFDOMAIN a 1", "2 c -1e-3", "# nothing", "1")


@query("scan_valued", _valued_sql())
def scan_valued(spark, d):
    """Features with values, rows of the domain only."""
    rows = T.valued(T.weighted_rows(_VALUED(spark)).where(~F.col("ood")))
    return rows.select("pos", "label", "name", "value")


_WEIGHTED, _WEIGHTED_SQL = lines_of("1 $$$WEIGHT 2.5 a b c", "0 a $$$TASK 3 b # note", "# only a comment", "2 $$$OUTOFDOMAIN x", "1 plain")


@query(
    "scan_weighted",
    "with " + _WEIGHTED_SQL + r""", v as (select pos, trim(regexp_replace(value, '#.*$', '')) as v from lines), b as (
  select *, list_filter(string_split_regex(regexp_replace(v, '\$\$\$(WEIGHT\s+\S+|TASK\s+\S+|OUTOFDOMAIN)', ' ', 'g'), '\s+'), lambda x: x <> '') as w from v where v <> '')
select pos, w[1] as label, coalesce(try_cast(regexp_extract(v, '\$\$\$WEIGHT\s+(\S+)', 1) as double), 1.0) as weight, coalesce(try_cast(regexp_extract(v, '\$\$\$TASK\s+(\S+)', 1) as integer), 0) as task,
  contains(v, '$$$OUTOFDOMAIN') as ood, array_to_string(w[2:], ' ') as feats from b""",
)
def scan_weighted(spark, d):
    return T.weighted_rows(_WEIGHTED(spark)).withColumn("feats", F.array_join("feats", " "))


@query(
    "scan_explicit",
    with_units(
        "select dyad, pos, cast(k as integer) as class, array_to_string(list_filter(string_split(parts[k + 1], ' '), lambda x: x <> '') || ['**BIAS**' || k || '**'], ' ') as feats from (select dyad, pos, parts, unnest(range(len(parts))) as k from p)",
        "p as (select dyad, pos, [array_to_string(toks[1:3], ' '), array_to_string(toks[4:], ' ')] as parts from u where not list_contains(toks, '#'))",
    ),
)
def scan_explicit(spark, d):
    """Three words for the first class and all others for the second."""
    u = units(spark, d).where(~F.array_contains("toks", "#"))
    line = F.concat(F.lit("1 # "), F.array_join(F.slice("toks", 1, 3), " "), F.lit(" # "), F.array_join(F.slice("toks", F.lit(4), F.size("toks")), " "))
    rows = T.explicit_rows(u.select(unit_key(F.col("dyad"), F.col("pos")).alias("pos"), line.alias("value")))
    return rows.select(*of_unit("pos"), "class", F.array_join("feats", " ").alias("feats"))


_LINES_OF_UNITS = "t as (select row_number() over (order by " + key_sql("dyad", "pos") + ") as pos, md5(unit) as value, role from u)"


@query(
    "scan_filespec",
    with_units(
        "select 0 as file, 'train' as split, pos, value, cast(0.5 as double) as weight from t where pos between 1 and 2 or pos = 4 or pos >= 6 "
        "union all select 1, 'dev', pos, role, cast(1 as double) from t union all select 2, 'test', pos, value, cast(2 as double) from t where pos = 3",
        _LINES_OF_UNITS,
    ),
)
def scan_filespec(spark, d):
    """Two files by a specification of three lines: a file may be named again with other lines and another weight."""
    u = units(spark, d).select(unit_key(F.col("dyad"), F.col("pos")).alias("key"), F.md5("unit").alias("unit"), "role")
    a, b = (write_lines(u, a_path(spark, "spec"), "key", value=c) for c in ("unit", "role"))
    return specified(spark, [f"{a} train 1-2,4,6-end weight 0.5", f"{b} dev all", f"{a} test 3 weight 2"])


@query(
    "scan_crf_items",
    with_units(
        "select dyad, pos, code as label, name as attr, cast(scale as double) as scale from (select dyad, pos, code, unnest(toks) as name, unnest(range(1, len(toks) + 1)) as scale from u)"
    ),
)
def scan_crf_items(spark, d):
    """Items of all words written with escapes and scales, sequences ended by empty lines, and read again."""
    u = units(spark, d)
    at = unit_key(F.col("dyad"), F.col("pos"))
    esc = lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    attrs = F.transform("toks", lambda t, i: F.concat(esc(F.regexp_replace(t, "^#", "\\\\\\\\#")), F.lit(":"), (i + 1).cast("string")))
    lines = u.select(at.alias("pos"), F.concat_ws("\t", "code", F.array_join(attrs, "\t")).alias("value"))
    ends = u.groupBy("dyad").agg((F.max("pos") + 1).alias("pos")).select(unit_key(F.col("dyad"), F.col("pos")).alias("pos"), F.lit("").alias("value"))
    return T.crf_items(lines.unionByName(ends)).select(*of_unit("pos"), "label", "attr", "scale")


GROUPS = "IP IR\n\nSF MU"
_GROUPS_SQL = "groups(label, gid, sub) as (values ('IP', 0, 0), ('IR', 0, 1), ('SF', 1, 0), ('MU', 1, 1))"


@query("scan_groups", "with " + _GROUPS_SQL + " select * from groups")
def scan_groups(spark, d):
    return T.label_groups(GROUPS, spark)


@query("coarse_relabel", with_units("select dyad, pos, gid, sub from u join groups on u.code = groups.label", _GROUPS_SQL))
def coarse_relabel(spark, d):
    return units(spark, d).join(F.broadcast(T.label_groups(GROUPS, spark)), F.col("code") == F.col("label")).select("dyad", "pos", "gid", "sub")


_CAT, _CAT_SQL = lines_of("%", "1\tfunction", "2\tmotion", "3\tstate", "%", "the 1", "of 1 3", "an* 2", "er* 2 3", "<of>x (y) 9", "und 1", "le 1", "en* 3")
_LEX_SQL = r"""lex as (select case when right(f[1], 1) = '*' then left(f[1], length(f[1]) - 1) else f[1] end as word, right(f[1], 1) = '*' as partial, pos as ord,
  case when contains(value, '<of>') or contains(value, '(') then [] else f[2:] end as ids from (select *, string_split_regex(value, '\s+') as f from lines where pos > 5))"""


@query("lex_category_load", "with " + _CAT_SQL + ", " + _LEX_SQL + " select word, partial, ord, array_to_string(ids, ' ') as ids from lex")
def lex_category_load(spark, d):
    return T.category_lexicon(_CAT(spark))[1].withColumn("ids", F.array_join("ids", " "))


@query(
    "category_tag",
    with_units(
        "select tok, ord from exact union all select tok, max(ord) from lex, t where partial and contains(tok, word) and tok not in (select tok from exact) group by tok",
        _CAT_SQL, _LEX_SQL, "t as (select distinct lower(unnest(toks)) as tok from u)", "exact as (select tok, min(ord) as ord from t join lex on tok = word and not partial group by tok)",
    ),
)
def category_tag(spark, d):
    toks = units(spark, d).select(F.explode(F.transform("toks", lambda t: F.lower(t))).alias("tok"))
    return tag_tokens(toks, T.category_lexicon(_CAT(spark))[1])


_SUBJ, _SUBJ_SQL = lines_of(
    "type=strongsubj len=1 word1=the pos1=adj stemmed1=n priorpolarity=negative", "type=weaksubj len=1 word1=an pos1=verb stemmed1=y priorpolarity=positive",
    "type=weaksubj len=1 word1=the pos1=adj stemmed1=n m priorpolarity=neutral", "type=strongsubj len=1 word1=er pos1=noun stemmed1=y priorpolarity=both", "type=weaksubj len=1 word1=of pos1=noun stemmed1=1 priorpolarity=neutral",
    "type=weaksubj len=1 word1=the pos1=noun stemmed1=n priorpolarity=positive",
)
_SUBJ_LEX = r"""kv as (select pos, regexp_extract(value, 'word1=(\S+)', 1) as word, regexp_extract(value, 'pos1=(\S+)', 1) as pos_tag, regexp_extract(value, 'type=(\S+)', 1) as kind,
  regexp_extract(value, 'priorpolarity=(\S+)', 1) as polarity, regexp_extract(value, 'stemmed1=(\S+)', 1) as stem from lines),
subj as (select word, pos_tag, arg_max(kind, pos) as kind, arg_max(polarity, pos) as polarity, arg_max(stem, pos) = 'y' as stemmed, max(pos) as ord from kv group by word, pos_tag)"""


@query("lex_subj_load", "with " + _SUBJ_SQL + ", " + _SUBJ_LEX + " select word, pos_tag, kind, polarity, stemmed from subj")
def lex_subj_load(spark, d):
    return T.subjectivity_lexicon(_SUBJ(spark))


def _subjective(spark, d, single: bool):
    """Entries of tokens; without a tag to go by, only words of one tag count."""
    lex = T.subjectivity_lexicon(_SUBJ(spark))
    one = lex.withColumn("n", F.count("*").over(Window.partitionBy("word")))
    lex = one.where("n = 1") if single else one
    lex = lex.join(O.with_index(lex.select("word").distinct(), "word", name="ord").withColumn("ord", F.col("ord") + 1), "word")
    toks = units(spark, d).select(F.explode(F.transform("toks", lambda t: F.lower(t))).alias("tok"))
    hits = tag_tokens(toks, lex.select("word", F.col("stemmed").alias("partial"), "ord").distinct())
    return hits.join(lex, "ord").select("tok", "word", "pos_tag", "polarity")


def _subj_sql(single: bool) -> str:
    return with_units(
        "select tok, word, pos_tag, polarity from h join ranked using (ord)", _SUBJ_SQL, _SUBJ_LEX,
        "ranked as (select word, pos_tag, polarity, stemmed, dense_rank() over (order by word) as ord from (select *, count(*) over (partition by word) as n from subj)" + (" where n = 1" if single else "") + ")",
        "t as (select distinct lower(unnest(toks)) as tok from u)", "exact as (select tok, min(ord) as ord from t join ranked on tok = word and not stemmed group by tok)",
        "h as (select tok, ord from exact union all select tok, max(ord) from ranked, t where stemmed and contains(tok, word) and tok not in (select tok from exact) group by tok)",
    )


@query("subj_tag", _subj_sql(False))
def subj_tag(spark, d):
    return _subjective(spark, d, False)


@query("subj_inquire", _subj_sql(True))
def subj_inquire(spark, d):
    return _subjective(spark, d, True)


_GAZ, _GAZ_SQL = lines_of("1\tone", "2\ttwo", "ORDINAL\tfirst", "ORDINAL\tthe")


@query("lex_gazetteer_load", "with " + _GAZ_SQL + " select split_part(value, chr(9), 2) as word, split_part(value, chr(9), 1) as value from lines")
def lex_gazetteer_load(spark, d):
    f = F.split("value", "\t")
    return _GAZ(spark).select(F.get(f, F.lit(1)).alias("word"), F.get(f, F.lit(0)).alias("value"))


@query(
    "gazetteer_tag",
    with_units("select t.tok, case when g.value is null then t.tok when g.value = 'ORDINAL' then 'ORDINAL' else '####@#####' end as tagged from t left join g on t.tok = g.word", _GAZ_SQL, "t as (select distinct lower(unnest(toks)) as tok from u)", "g as (select split_part(value, chr(9), 2) as word, split_part(value, chr(9), 1) as value from lines)"),
)
def gazetteer_tag(spark, d):
    toks = units(spark, d).select(F.explode(F.transform("toks", lambda t: F.lower(t))).alias("tok")).distinct()
    g = lex_gazetteer_load(spark, d)
    return toks.join(g, F.col("tok") == F.col("word"), "left").select("tok", F.when(F.col("value").isNull(), F.col("tok")).when(F.col("value") == "ORDINAL", "ORDINAL").otherwise("####@#####").alias("tagged"))


_RULES, _RULES_SQL = lines_of("1 S --> NP VP", "0.5 0.1 2 NP --> Det N", "0 VP --> V NP", "Det --> the", "2.5 N --> dog cat")


@query(
    "scan_grammar",
    "with " + _RULES_SQL + r""", m as (select pos, string_split_regex(trim(split_part(value, '-->', 1)), '\s+') as h, trim(split_part(value, '-->', 2)) as children from lines)
select pos, case when len(h) > 1 and cast(h[1] as double) > 0 then cast(h[1] as double) else 1.0::double end as weight, case when len(h) > 2 then cast(h[2] as double) end as a, case when len(h) > 3 then cast(h[3] as double) end as b, h[-1] as parent, children from m""",
)
def scan_grammar(spark, d):
    return T.grammar_rules(_RULES(spark))


@query("incr_ids", with_units("select tok, row_number() over (order by first, tok) - 1 as id from (select tok, min(p) as first from (select unnest(toks) as tok, " + key_sql("dyad", "pos") + " as p from u) group by tok)"))
def incr_ids(spark, d):
    t = units(spark, d).select(F.explode("toks").alias("tok"), unit_key(F.col("dyad"), F.col("pos")).alias("p"))
    return O.first_seen_ids(t, "tok", "p")


@query("feat_dict", xsql("select f, id from dict", E.DICTIONARY_SQL))
def feat_dict(spark, d):
    return E.dictionary(E.instances(spark, d))


@query("encode_sparse", xsql("select rid, split, label, id from l join dict using (f) union all select rid, split, label, 0 from x", E.DICTIONARY_SQL))
def encode_sparse(spark, d):
    x = E.instances(spark, d)
    return E.encode(x, E.dictionary(x))


@query("write_indexed", xsql("select rid, label || ' ' || array_to_string(list(id || ':1' order by id), ' ') as line from (select rid, label, id from l join dict using (f)) group by rid, label", E.DICTIONARY_SQL))
def write_indexed(spark, d):
    x = E.instances(spark, d)
    e = E.encode(x, E.dictionary(x)).where("id > 0").groupBy("rid", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return e.select("rid", F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform("ids", lambda i: F.concat(i.cast("string"), F.lit(":1"))), " ")).alias("line"))


@query("feature_positions", xsql("select rid, array_to_string(list('pos' || id order by id), ' ') as line from (select rid, id from l join dict using (f)) group by rid", E.DICTIONARY_SQL))
def feature_positions(spark, d):
    x = E.instances(spark, d)
    e = E.encode(x, E.dictionary(x)).where("id > 0").groupBy("rid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return e.select("rid", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("pos"), i.cast("string"))), " ").alias("line"))


@query("num_to_code", xsql("select rid, ['IP', 'IR', 'SF', 'MU'][label + 1] as code from x"))
def num_to_code(spark, d):
    codes = spark.createDataFrame(list(enumerate(E.CODES)), "label int, code string")
    return E.instances(spark, d).join(F.broadcast(codes), "label").select("rid", "code")


_TWO = "a as (select rid, label, list_filter(feats, lambda f: length(f) % 2 = 0) as f from x)", "b as (select rid, label, list_filter(feats, lambda f: length(f) % 3 = 0) as f from x)"


def _two(spark, d):
    x = E.instances(spark, d)
    part = lambda n: x.select("rid", F.col("label").alias(f"l{n}"), F.filter("feats", lambda f: F.length(f) % n == 0).alias(f"f{n}"))
    return part(2), part(3)


@query("merge_feats", xsql("select a.rid, a.label, array_to_string(list_sort(list_distinct(a.f || b.f)), ' ') as feats from a join b on a.rid = b.rid and a.label = b.label", *_TWO))
def merge_feats(spark, d):
    a, b = _two(spark, d)
    both = a.join(b, "rid").withColumn("same", F.assert_true(F.col("l2") == F.col("l3")))
    return both.where("same is null").select("rid", F.col("l2").alias("label"), F.array_join(F.sort_array(F.array_union("f2", "f3")), " ").alias("feats"))


@query("append_feats", xsql("select a.rid, array_to_string(a.f || b.f, ' ') as feats from a join b using (rid)", *_TWO))
def append_feats(spark, d):
    """Features of two files put together row by row; a row without its partner is an error."""
    a, b = _two(spark, d)
    both = a.join(b, "rid", "full").withColumn("same", F.assert_true(F.col("l2").isNotNull() & F.col("l3").isNotNull(), "the files differ in length"))
    return both.where("same is null").select("rid", F.array_join(F.concat("f2", "f3"), " ").alias("feats"))


@query("filter_freq", xsql("select rid, array_to_string(list(f order by f), ' ') as feats from l where f in (select f from l group by f having count(*) >= 3) group by rid union all select rid, '' from x where rid not in (select rid from l where f in (select f from l group by f having count(*) >= 3))"))
def filter_freq(spark, d):
    return E.frequent_only(E.instances(spark, d), 3).select("rid", F.array_join("feats", " ").alias("feats"))


@query("filter_minfc", xsql("select f, count(distinct rid) as n from l group by f having count(distinct rid) >= 4"))
def filter_minfc(spark, d):
    x = E.long_form(E.frequent_only(E.instances(spark, d), 4, documents=True))
    return x.groupBy("f").agg(F.countDistinct("rid").alias("n"))


@query("freq_list", "select w, count(*) as n from (select unnest(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) as w from documents) group by w")
def freq_list(spark, d):
    return table(spark, d, "documents").select(F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("freq_topn", "select w, count(*) as n from (select unnest(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) as w from documents) group by w order by n desc, w limit 20")
def freq_topn(spark, d):
    return freq_list(spark, d).orderBy(F.desc("n"), "w").limit(20)


@query("pos_usage", with_units("select distinct code || '_1' as usage from u"))
def pos_usage(spark, d):
    """Each tag with count 1, as observed; ``pos_counts`` has the counts."""
    return units(spark, d).select(F.concat("code", F.lit("_1")).alias("usage")).distinct()


@query("pos_counts", with_units("select code, count(*) as n from u group by code"))
def pos_counts(spark, d):
    return units(spark, d).groupBy("code").agg(F.count("*").alias("n"))


@query("inverted_index", xsql("select f, rid // 4294967296 // 1000 as part, array_to_string(list_sort(list_distinct(list(rid))), ' ') as rids from l group by f, part"))
def inverted_index(spark, d):
    """Rows of each feature, in parts of 1,000 conversations: a posting list is bounded by its part."""
    part = F.floor(key_parts(F.col("rid"))[0] / 1000).cast("long").alias("part")
    post = E.long_form(E.instances(spark, d)).groupBy("f", part).agg(F.collect_set("rid").alias("r"))
    return post.select("f", "part", F.array_join(F.sort_array("r"), " ").alias("rids"))


@query("concat_splits", xsql("select split, count(*) as n, cast(sum(label) as bigint) as labels from x group by split"))
def concat_splits(spark, d):
    x = E.instances(spark, d)
    parts = [x.where(F.col("split") == s).drop("split").withColumn("split", F.lit(s)) for s in ("train", "dev", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("label_union", xsql("select label from x where split = 'train' union select (label + 1) % 5 from x where split = 'test'").replace("select label from", "select cast(label as integer) as label from").replace("select (label + 1) % 5", "select cast((label + 1) % 5 as integer)"))
def label_union(spark, d):
    x = E.instances(spark, d)
    return x.where("split = 'train'").select("label").union(x.where("split = 'test'").select(((F.col("label") + 1) % 5).cast("int"))).distinct()


@query("learning_curve", xsql("select size, count(*) as n, cast(sum(rid % 1000003) as bigint) as rids from (select rid, row_number() over (order by md5(cast(rid as varchar)), rid) as k from x where split = 'train') join (select cast(10 * pow(2, i) as bigint) as size from range(0, 50) t(i)) on k <= size where size < (select count(*) from x where split = 'train') group by size"))
def learning_curve(spark, d):
    """Nested samples of one permutation, of 10 rows and twice as many each time, below all rows.

    A row is counted once, in the smallest sample that has it; the few samples' sums are added up."""
    x = E.instances(spark, d).where("split = 'train'").select("rid", F.md5(F.col("rid").cast("string")).alias("o"))
    k = O.with_index(x, "o", "rid", name="k")
    tens = F.floor(F.col("k") / 10)
    step = F.when(tens == 0, 0).otherwise(F.length(F.bin(tens)))
    per = k.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col("rid") % 1000003).alias("rids"))
    upto = Window.orderBy("step")  # a row for each doubling
    sums = per.select(F.expr("shiftleft(10L, step)").alias("size"), F.sum("n").over(upto).alias("n"), F.sum("rids").over(upto).alias("rids"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    return sums.where("size < rows").select("size", "n", "rids")


@query("corpus_stats", with_units("select count(distinct dyad) as sequences, count(*) as items, count(distinct code) as labels, (select max(n) from (select count(*) as n from u group by dyad)) as longest, (select count(distinct f) from (select unnest(toks) as f from u)) as attributes from u"))
def corpus_stats(spark, d):
    u = units(spark, d)
    one = u.agg(F.countDistinct("dyad").alias("sequences"), F.count("*").alias("items"), F.countDistinct("code").alias("labels"))
    longest = u.groupBy("dyad").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))
    attrs = u.select(F.explode("toks").alias("f")).agg(F.countDistinct("f").alias("attributes"))
    return one.crossJoin(F.broadcast(longest)).crossJoin(F.broadcast(attrs))  # three rows in all


@query("parse_feat_line", xsql("select rid, cast(label as varchar) as label, array_to_string(feats, ' ') as feats from x"))
def parse_feat_line(spark, d):
    line = F.concat(F.col("label").cast("string"), F.lit("\t"), F.array_join("feats", " "))
    parts = F.split(line, r"\s+", 2)
    return E.instances(spark, d).select("rid", F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("feats"))


_LABELS, _LABELS_SQL = lines_of("-3", "2", "0.4", "0.7", "1.7", "1:x:0.5", "0.2:0.1:3")


@query(
    "label_parsers",
    "with " + _LABELS_SQL + """ select pos, greatest(cast(trunc(try_cast(split_part(value, ':', 1) as double)) as integer), 0) as int_label, case when try_cast(split_part(value, ':', 1) as double) < 0.5 then 0 else 1 end as binary_label,
  least(greatest(try_cast(split_part(value, ':', 1) as double), 0), 1) as binomial, array_to_string(list_transform(string_split(value, ':'), lambda c: case when c = 'x' then 'inf' else c end), ' ') as costs from lines""",
)
def label_parsers(spark, d):
    v = F.get(F.split("value", ":"), F.lit(0)).cast("double")
    costs = F.array_join(F.transform(F.split("value", ":"), lambda c: F.when(c == "x", "inf").otherwise(c)), " ")
    return _LABELS(spark).select("pos", F.greatest(v.cast("int"), F.lit(0)).alias("int_label"), F.when(v < 0.5, 0).otherwise(1).alias("binary_label"), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("binomial"), costs.alias("costs"))


@query("argmin_cost", xsql("select rid, list_position(c, list_min(c)) - 1 as best from (select rid, [rid % 7, rid % 5, rid % 3 + 1] as c from x)").replace("as best", "as best"))
def argmin_cost(spark, d):
    c = F.array(F.col("rid") % 7, F.col("rid") % 5, F.col("rid") % 3 + 1)
    return E.instances(spark, d).select("rid", (F.array_position(c, F.array_min(c)) - 1).cast("int").alias("best"))


@query("empty_filler", with_units("select dyad, pos, array_to_string(case when len(t) = 0 then ['EMPTY'] else t end, ' ') as toks from (select *, list_filter(toks, lambda x: length(x) > 9) as t from u)"))
def empty_filler(spark, d):
    t = F.filter("toks", lambda x: F.length(x) > 9)
    return units(spark, d).select("dyad", "pos", F.array_join(F.when(F.size(t) == 0, F.array(F.lit("EMPTY"))).otherwise(t), " ").alias("toks"))


@query("stopwords", with_units("select dyad, pos, array_to_string(list_filter(toks, lambda x: x not in ('the', 'of', 'and', 'to', 'der', 'die', 'le', 'la', 'de')), ' ') as toks from u"))
def stopwords(spark, d):
    return units(spark, d).select("dyad", "pos", F.array_join(F.filter("toks", lambda x: ~x.isin("the", "of", "and", "to", "der", "die", "le", "la", "de")), " ").alias("toks"))


@query("digitize", "select doc_id, md5(array_to_string(list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''), lambda t: regexp_replace(t, '[0-9]', '@', 'g')), ' ')) as digest from documents")
def digitize(spark, d):
    t = F.transform(X.tokens(F.coalesce("text", F.lit(""))), X.digitize)
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(t, " ")).alias("digest"))


@query("token_tags", with_units("select tok, case when regexp_matches(tok, '^[A-Za-z]+$') then 'ALPHA' else '' end as alpha, case when regexp_matches(tok, '^[A-Za-z0-9]+$') then '' else 'NALPHA' end as nalpha from (select distinct unnest(toks) as tok from u)"))
def token_tags(spark, d):
    t = units(spark, d).select(F.explode("toks").alias("tok")).distinct()
    return t.select("tok", F.when(F.col("tok").rlike("^[A-Za-z]+$"), "ALPHA").otherwise("").alias("alpha"), F.when(F.col("tok").rlike("^[A-Za-z0-9]+$"), "").otherwise("NALPHA").alias("nalpha"))


def _entities_sql() -> str:
    c = "unit || ' @@:@@pm $@@ , 5 @@degrees @percent ookhh'"
    for pattern, name in X.ENTITIES:
        c = f"regexp_replace({c}, '{pattern}', ' {name} ', 'g')"
    return with_units(f"select dyad, pos, {c} as unit from u")


@query("entity_tag", _entities_sql())
def entity_tag(spark, d):
    return units(spark, d).select("dyad", "pos", X.tag_entities(F.concat("unit", F.lit(" @@:@@pm $@@ , 5 @@degrees @percent ookhh"))).alias("unit"))


@query("porter")
def porter(spark, d):
    """Stems of distinct tokens, in Arrow batches."""

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(X.porter_stem)

    t = units(spark, d).select(F.explode(F.transform("toks", lambda t: F.lower(t))).alias("tok")).distinct()
    return t.select("tok", stem("tok").alias("stem"))


@query(
    "pos_backoff",
    with_units(
        "select dyad, pos, k, coalesce(b.tag, g.tag, 'NN') as tag from i left join b using (prev, w) left join g using (w)",
        TOKENS_SQL,
        "i as (select dyad, pos, k, w, tag, coalesce(lag(tag) over (partition by dyad, pos order by k), '<s>') as prev from tk)",
        "b as (select prev, w, tag from (select prev, w, tag, row_number() over (partition by prev, w order by count(*) desc, tag) as k from i where pos % 3 > 0 group by prev, w, tag) where k = 1)",
        "g as (select w, tag from (select w, tag, row_number() over (partition by w order by count(*) desc, tag) as k from i where pos % 3 > 0 group by w, tag) where k = 1)",
    ),
)
def pos_backoff(spark, d):
    """A tagger trained from counts: by previous tag and word, else by word, else NN."""
    w = Window.partitionBy("dyad", "pos").orderBy("k")
    i = token_items(spark, d).withColumn("prev", F.coalesce(F.lag("tag").over(w), F.lit("<s>")))
    train = i.where("pos % 3 > 0")

    def best(*keys):
        n = train.groupBy(*keys, "tag").agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("-".join(keys)))

    both = i.drop("tag").join(best("prev", "w"), ["prev", "w"], "left").join(best("w").withColumnRenamed("w", "w0").toDF("w", "uni"), "w", "left")
    return both.select("dyad", "pos", "k", F.coalesce("prev-w", "uni", F.lit("NN")).alias("tag"))


def _norm(name: str, p: int) -> None:
    total = "list_sum(list_transform(v, lambda x: abs(x)))" if p == 1 else "sqrt(list_sum(list_transform(v, lambda x: x * x)))"

    @query(name, f"select vec_id, cast(k as integer) as k, round(v[k + 1] / {total}, 6) as value from (select vec_id, v, unnest(range(len(v))) as k from (select vec_id, cast(embedding as double[]) as v from embeddings))")
    def run(spark, d):
        v = F.col("v")
        size = F.aggregate(v, F.lit(0.0), lambda a, x: a + (F.abs(x) if p == 1 else x * x), lambda a: a if p == 1 else F.sqrt(a))
        return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("s", size).select("vec_id", F.posexplode("v").alias("k", "x"), "s").select("vec_id", "k", F.round(F.col("x") / F.col("s"), 6).alias("value"))


_norm("norm_l1", 1)
_norm("norm_l2", 2)
