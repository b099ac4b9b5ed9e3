"""Queries: windowed features and n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import features as W
from turnloom.plans.registry import query
from turnloom.sources.units import TOKENS_SQL, token_items, units, with_units

EMPTY = "cast([] as varchar[])"
WINDOW = 5  # of skip-grams


def near_sql(back: int, forward: int, col: str = "toks") -> str:
    cols = [f"coalesce({fn}({col}, {j}) over w, {EMPTY}) as {side}{j}" for side, fn, n in (("b", "lag", back), ("f", "lead", forward)) for j in range(1, n + 1)]
    return f"n as (select *, {', '.join(cols) or '1 as one'} from u window w as (partition by dyad order by pos))"


def tag_sql(prefix: str, t: str) -> str:
    return f"list_transform({t}, lambda x: '{prefix}' || x)"


def join_sql(*parts: str) -> str:
    return f"array_to_string(list_sort(list_distinct({' || '.join(parts)})), chr(9))"


def gram_sql(t: str, n: int, sep: str) -> str:
    return f"list_transform(range(1, greatest(len({t}) - {n} + 2, 1)), lambda i: array_to_string(({t})[i:i + {n - 1}], '{sep}'))"


def pad_sql(t: str, left: int) -> str:
    marks = ", ".join(["'<s>'"] * left)
    return f"([{marks}] || {t} || ['</s>'])"


def skip_sql(t: str, n: int, window: int, keep: int | None = None) -> str:
    """Nested list comprehensions over places."""
    keep = keep or n
    names = "ijkl"
    shown = " || '/' || ".join(f"({t})[{x}]" for x in names[:keep])
    body = f"[{shown}]"
    for d in range(n - 1, 0, -1):
        body = f"flatten(list_transform(range({names[d - 1]} + 1, least(i + {window}, len({t})) + 1), lambda {names[d]}: {body}))"
    return f"flatten(list_transform(range(1, len({t}) + 1), lambda i: {body}))"


def three_sql(prefix: str, infix: str, t: str) -> list[str]:
    return [tag_sql(f"{prefix}1_{infix}", t), tag_sql(f"{prefix}2_{infix}", gram_sql(pad_sql(t, 1), 2, "/")), tag_sql(f"{prefix}3_{infix}", gram_sql(pad_sql(t, 2), 3, "/"))]


def sides(back: int, forward: int) -> list[tuple[str, int, str]]:
    return [("BACK", j, f"b{j}") for j in range(1, back + 1)] + [("FORWARD", j, f"f{j}") for j in range(1, forward + 1)]


def window_sql(back: int, forward: int) -> str:
    feats = join_sql("['SPEAKER_' || role]", tag_sql("CUR_", "toks"), *[tag_sql(f"{s}_{j}_", c) for s, j, c in sides(back, forward)])
    return with_units(f"select dyad, pos, role, code, {feats} as feats from n", near_sql(back, forward))


@query("feats_window", window_sql(1, 1))
def feats_window(spark, d):
    return W.window_features(units(spark, d))


@query("feats_window2", window_sql(2, 2))
def feats_window2(spark, d):
    return W.window_features(units(spark, d), 2, 2)


@query(
    "feats_speaker",
    with_units(
        "select dyad, pos, array_to_string(list_sort(list_distinct(['CUR_SPEAKER_' || role, 'BACK_1_SPEAKER_' || coalesce(lag(role) over w, 'None'), "
        "'FORWARD_1_SPEAKER_' || coalesce(lead(role) over w, 'None')])), chr(9)) as feats from u window w as (partition by dyad order by pos)"
    ),
)
def feats_speaker(spark, d):
    return W.speaker_features(units(spark, d))


@query("feats_3g", with_units(f"select dyad, pos, {join_sql('''['SPEAKER_' || role]''', *three_sql('CUR', '', 'toks'))} as feats from u"))
def feats_3g(spark, d):
    return W.trigram_features(units(spark, d))


_3GW = join_sql("['SPEAKER_' || role]", *three_sql("CUR", "", "toks"), *[x for s, j, c in sides(1, 1) for x in three_sql(s, f"{j}_", c)])


@query("feats_3gw", with_units(f"select dyad, pos, {_3GW} as feats from n", near_sql(1, 1)))
def feats_3gw(spark, d):
    return W.trigram_window_features(units(spark, d))


def _skip_parts(prefix: str, t: str) -> list[str]:
    four = skip_sql(pad_sql(t, 3), 4, WINDOW, 3)
    return [tag_sql(f"{prefix}_UNIGRAM_", t), tag_sql(f"{prefix}_BIGRAM_", skip_sql(pad_sql(t, 1), 2, WINDOW)), tag_sql(f"{prefix}_TRIGRAM_", skip_sql(pad_sql(t, 2), 3, WINDOW)), tag_sql(f"{prefix}_FOURGRAM_", four)]


_SKIP = join_sql(*_skip_parts("CUR", "toks"), *[x for s, j, c in sides(1, 1) for x in _skip_parts(f"{s}_{j}", c)])


@query("feats_skipgram", with_units(f"select dyad, pos, {_SKIP} as feats from n", near_sql(1, 1)))
def feats_skipgram(spark, d):
    return W.skip_features(units(spark, d), window=WINDOW)


def _counted(name: str, n: int, keep: int | None = None, window: int = WINDOW) -> None:
    t = pad_sql("toks", n - 1)
    sql = with_units("select gram, count(*) as n from g group by gram", f"g as (select unnest({skip_sql(t, n, window, keep)}) as gram from u)")

    @query(name, sql)
    def run(spark, d):
        grams = X.skip_grams(X.padded(F.col("toks"), n - 1), n, window, keep)
        return units(spark, d).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_counted("skip_bigrams", 2)
_counted("skip_trigrams", 3)
_counted("skip_fourgrams", 4, keep=3)


@query("ngrams_n", with_units("select n, gram, count(*) as k from g group by n, gram", "g as (" + " union all ".join(f"select {n} as n, unnest({gram_sql('toks', n, ' ')}) as gram from u" for n in (1, 2, 3)) + ")"))
def ngrams_n(spark, d):
    u = units(spark, d)
    numbered = lambda n: F.transform(X.ngrams(F.col("toks"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    rows = F.concat(*map(numbered, (1, 2, 3)))
    return u.select(F.inline(rows)).groupBy("n", "gram").agg(F.count("*").alias("k"))


@query("tokens", with_units("select dyad, pos, cast(len(toks) as integer) as n, array_to_string(toks, ' ') as text from u"))
def tokens(spark, d):
    return units(spark, d).select("dyad", "pos", F.size("toks").alias("n"), F.array_join("toks", " ").alias("text"))


_PHRASES = "p as (select gram as phrase from (select unnest(" + gram_sql("toks", 3, "_") + " || " + gram_sql("toks", 4, "_") + ") as gram from u2) group by gram having count(*) > 1)"
_CLEAN = r"u2 as (select dyad, pos, list_filter(string_split_regex(replace(unit, '_', ''), '[ \t\n\r\f\x0b]+'), lambda x: x <> '') as toks from u)"
_HITS = "h as (select distinct dyad, pos, gram from (select dyad, pos, unnest(" + gram_sql("toks", 3, "_") + " || " + gram_sql("toks", 4, "_") + ") as gram from u2) where gram in (select phrase from p))"


def _phrases(u):
    toks = X.tokens(F.replace("unit", F.lit("_"), F.lit("")))
    grams = F.concat(X.ngrams(toks, 3, "_"), X.ngrams(toks, 4, "_"))
    return u.select(F.explode(grams).alias("phrase")).groupBy("phrase").count().where("count > 1").select("phrase")


@query("colloc_match", with_units("select dyad, pos, gram as phrase from h", _CLEAN, _PHRASES, _HITS))
def colloc_match(spark, d):
    u = units(spark, d)
    toks = X.tokens(F.replace("unit", F.lit("_"), F.lit("")))
    grams = F.array_distinct(F.concat(X.ngrams(toks, 3, "_"), X.ngrams(toks, 4, "_")))
    return u.select("dyad", "pos", F.explode(grams).alias("phrase")).join(_phrases(u), "phrase", "left_semi")


@query(
    "feats_colloc",
    with_units(
        "select dyad, pos, array_to_string(list_sort(list_distinct(list_transform(c, lambda x: 'CUR_COLLOC_' || x) || list_transform(b, lambda x: 'BACK_1_COLLOC_' || x) "
        "|| list_transform(f, lambda x: 'FORWARD_1_COLLOC_' || x))), chr(9)) as feats from n",
        _CLEAN, _PHRASES, _HITS, f"e as (select u.dyad, u.pos, coalesce(list(gram) filter (gram is not null), {EMPTY}) as c from u left join h on u.dyad = h.dyad and u.pos = h.pos group by u.dyad, u.pos)",
        f"n as (select *, coalesce(lag(c) over w, {EMPTY}) as b, coalesce(lead(c) over w, {EMPTY}) as f from e window w as (partition by dyad order by pos))",
    ),
)
def feats_colloc(spark, d):
    u = units(spark, d)
    return W.collocation_features(u, _phrases(u), 4, 1, 1)


_TEMPLATE_COLS = [(0, "w", s) for s in ((-2,), (-1,), (0,), (1,), (2,), (-1, 0), (0, 1))]
_TEMPLATE_COLS += [(1, "p", s) for s in ((-2,), (-1,), (0,), (1,), (2,), (-2, -1), (-1, 0), (0, 1), (1, 2))]
_TEMPLATE_COLS += [(2, "p", s) for s in ((-2, -1, 0), (-1, 0, 1), (0, 1, 2))]


def _template_sql() -> str:
    cell = lambda c, j: f"coalesce(lag({c}, {-j}) over w, '')" if j < 0 else f"coalesce(lead({c}, {j}) over w, '')" if j else c
    seen: dict[int, int] = {}
    feats = []
    for g, c, s in _TEMPLATE_COLS:
        k = seen.get(g, 0)
        seen[g] = k + 1
        feats.append(f"'U{g}{k}=' || " + " || '/' || ".join(cell(c, j) for j in s))
    return with_units(f"select dyad, pos, array_to_string([{', '.join(feats)}], chr(9)) as feats from i window w as (partition by dyad order by pos)", TOKENS_SQL, "i as (select dyad || ':' || pos as dyad, k as pos, w, tag as p from tk)")


@query("feats_conll", _template_sql())
def feats_conll(spark, d):
    """Every token is an item, every turn a sequence."""
    return W.template_features(token_items(spark, d).select(F.concat_ws(":", "dyad", "pos").alias("dyad"), F.col("k").alias("pos"), "w", F.col("tag").alias("p")))
