r"""Personal data: patterns propose spans, checksums and ranges confirm, nearby words score.

Patterns are anchored so that a long run of one character costs linear time: a run is entered at
its start or where the last match ended (``\G``), and repeats never give back.  The matches are
those of the plain pattern, leftmost and non-overlapping.  Offsets come from the parts between
matches, so everything stays in DataFrame expressions.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn) and phone (9 to 15 digits) are
kept as soon as their check holds.  The method adds iban (mod-97), ssn and secret, which have no
letter or digit beside them and need a score of ``KEEP``.

A score has points for the form, for a checksum that holds, and for the ``CONTEXT`` characters of the
text on each side: ``NEAR_POINTS`` for one of the kind's words within ``NEAR``, else ``FAR_POINTS`` for
one further off, and ``MORE_POINTS`` for a second one; 100 at most.  Spans of all kinds carry it.

Every start of an iban is tried, as it has no end of its own: first the length of its country, then
what ends with a group of characters, longest first.  The first that leaves 1 by 97 is the span, and
spans do not overlap.

Edge cases: null text is empty and has no spans; equal rows give equal results; ids may be null
or repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.words import let

CONTEXT, NEAR, KEEP = 40, 20, 75
NEAR_POINTS, FAR_POINTS, MORE_POINTS = 40, 20, 15

#: Kind -> (cheap test that every match passes, pattern, points for the form and for the check, words of its context).
KINDS: dict[str, tuple[str, str, int, int, tuple[str, ...]]] = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 60, 0, ("mail", "contact", "write")),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 40, 20, ("address", "host", "server", "login")),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?[0-9])++", 30, 35, ("card", "visa", "credit", "payment")),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 50, 0, ("phone", "call", "tel", "mobile", "fax")),
    "iban": (r"[A-Z][0-9]", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 40, 35, ("iban", "bank", "account")),
    "ssn": (r"[0-9]-[0-9]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, 0, ("ssn", "social", "security", "tax")),
    "secret": (r"[0-9A-Fa-f]{32}", r"[0-9A-Fa-f]{32,64}", 40, 0, ("token", "secret", "key", "passw")),
}
BASE = ("email", "ip", "card", "phone")
#: Start of an account number, its rest as a group that is looked at only.
IBAN = "(?<![A-Za-z0-9])" + KINDS["iban"][1].replace("(?:", "(?=((?:") + "))"
#: Characters of an account number by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
SPANS = "array<struct<start:int,end:int,score:int>>"


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    step = lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(digit(i))).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 by 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    step = lambda acc, c: (acc * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), ""), F.lit(0), step) == 1


def _iban_length(found: Column) -> Column:
    """Characters of the account number that a string begins with, spaces among them; null without one."""
    code = lambda e: F.replace(F.left(found, e), F.lit(" "), F.lit(""))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    by_country = lambda e: F.coalesce(F.length(code(e)) == F.try_element_at(lengths, F.left(found, F.lit(2))), F.lit(False))
    at = lambda i: F.substring(found, i, F.lit(1))
    ends = F.filter(F.sequence(F.lit(15), F.length(found)), lambda e: (at(e) != " ") & (F.length(code(e)) >= 15) & (by_country(e) | at(e + 1).isin("", " ")))
    valid = F.filter(ends, lambda e: mod97(code(e)))
    return F.array_max(F.transform(valid, lambda e: F.struct(by_country(e).alias("by_country"), e.alias("e"))))["e"]


def _iban_spans(text: Column) -> Column:
    found = F.struct(F.regexp_extract_all(text, F.lit(IBAN), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(IBAN), F.lit(1)).alias("rest"), F.split(text, IBAN, -1).alias("between"))
    zipped = lambda b: F.arrays_zip(b["m"].alias("m"), b["rest"].alias("rest"), F.slice(b["between"], 1, F.size(b["m"])).alias("before"))
    step = lambda acc, x: let(
        F.struct((acc["at"] + F.length(x["before"])).alias("start"), F.concat(x["m"], x["rest"]).alias("found")),
        lambda c: let(
            F.struct(c["start"].alias("start"), F.when(c["start"] >= acc["to"], let(c["found"], _iban_length)).alias("n")),
            lambda s: F.struct(
                (s["start"] + F.length(x["m"])).alias("at"),
                F.coalesce(s["start"] + s["n"], acc["to"]).alias("to"),
                F.when(s["n"].isNotNull(), F.concat(acc["out"], F.array(_span("iban", s["start"], s["n"], F.left(text, s["start"]), F.substring(text, s["start"] + s["n"] + 1, F.lit(CONTEXT)))))).otherwise(acc["out"]).alias("out"),
            ),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"), F.array().cast(SPANS).alias("out"))
    return let(found, lambda b: F.aggregate(zipped(b), zero, step)["out"])


def _bytes(m: Column) -> Column:
    """All four parts of an address are at most 255, whatever zeros lead them."""
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    small = lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255
    return F.forall(F.split(m, r"\."), lambda p: part(p) & small(p))


def confirmed(kind: str, m: Column) -> Column:
    """The check of a kind, on the matched string."""
    if kind == "ip":
        return _bytes(m)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def find_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, score>> of a kind in a text that is not null."""
    cheap, pattern, *_ = KINDS[kind]
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between"))
    # the text as gaps and matches in turn, of each the ends that a context may need
    pieces = lambda b: F.flatten(F.zip_with(b["between"], b["m"], lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    ends = lambda b: F.struct(b["m"].alias("m"), b["between"].alias("between"), F.transform(pieces(b), lambda x: F.left(x, F.lit(CONTEXT))).alias("lefts"), F.transform(pieces(b), lambda x: F.right(x, F.lit(CONTEXT))).alias("rights"))
    zipped = lambda b: F.arrays_zip(b["m"].alias("m"), F.slice(b["between"], 1, F.size(b["m"])).alias("before"), F.sequence(F.lit(1), F.size(b["m"])).alias("k"))

    def scored(b, start, m, k):  # match k is piece 2k; each match has a character, so that many pieces hold a context
        first = F.greatest(2 * k - 2 * CONTEXT, F.lit(1))
        return _span(kind, start, F.length(m), F.array_join(F.slice(b["rights"], first, 2 * k - first), ""), F.array_join(F.slice(b["lefts"], 2 * k + 1, F.lit(2 * CONTEXT)), ""))

    step = lambda b: lambda acc, x: let(
        acc["at"] + F.length(x["before"]),
        lambda start: F.struct(
            (start + F.length(x["m"])).alias("at"),
            F.when(confirmed(kind, x["m"]), F.concat(acc["out"], F.array(scored(b, start, x["m"], x["k"])))).otherwise(acc["out"]).alias("out"),
        ),
    )
    none = F.array().cast(SPANS)
    fold = lambda b: F.when(F.size(b["m"]) > 0, F.aggregate(zipped(b), F.struct(F.lit(0).alias("at"), none.alias("out")), step(b))["out"]).otherwise(none)
    seen = _iban_spans(text) if kind == "iban" else let(parts, lambda b: let(ends(b), fold))
    # a text without the kind's cheap mark is not searched
    spans = F.when(text.rlike(cheap), seen).otherwise(none)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= KEEP)


def _span(kind: str, start: Column, n: Column, before: Column, after: Column) -> Column:
    """A confirmed match with its score; spans that must stand alone have none if they do not."""
    _, _, form, check, words = KINDS[kind]
    around = lambda size: F.lower(F.concat_ws(" ", F.right(before, F.lit(size)), F.left(after, F.lit(size))))
    count = lambda x: sum((F.when(F.contains(x, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    context = F.when(count(around(NEAR)) > 0, NEAR_POINTS).when(count(around(CONTEXT)) > 0, FAR_POINTS).otherwise(0) + F.when(count(around(CONTEXT)) > 1, MORE_POINTS).otherwise(0)
    score = F.least(F.lit(form + check) + context, F.lit(100))
    if kind in ("ssn", "secret"):
        score = F.when(F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") | F.left(after, F.lit(1)).rlike("[A-Za-z0-9]"), 0).otherwise(score)
    return F.struct(start.alias("start"), (start + n).alias("end"), score.cast("int").alias("score"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans per kind, over whole texts."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", *[find_spans(F.col("text"), k).alias(k) for k in KINDS])


def mask(docs: DataFrame) -> DataFrame:
    """Documents with each base match and scored span replaced by ``[KIND]``, kind after kind.

    Later kinds are sought in the text that the earlier ones left."""
    out = docs
    for kind in KINDS:
        out = out.withColumn("text", let(find_spans(F.coalesce("text", F.lit("")), kind), _cut(kind)))
    return out


def _cut(kind: str):
    """From spans to the text without them."""
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(f"[{kind.upper()}]")).alias("out"))
    fold = lambda v: F.aggregate(v, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = lambda x: F.concat(x["out"], F.substring(F.col("text"), x["at"] + 1, F.lit(2**31 - 1)))
    return lambda v: F.when(F.size(v) > 0, let(fold(v), rest)).otherwise(F.col("text"))


def _joined(kinds) -> Column:
    one = lambda k: F.transform(F.col(k), lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    return F.array_join(F.concat(*map(one, kinds)), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    spans = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
        F.array_join(F.flatten(F.array(*[F.transform(F.col(k), lambda s: s["score"].cast("string")) for k in KINDS])), ",").alias("scores"),
    )


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DOUBLED = "(2 * cast(x[j] as integer)) // 10 + (2 * cast(x[j] as integer)) % 10"
_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as integer), 0) > 255)) = 0",
    "card": f"length(x) between 13 and 19 and list_sum(list_transform(range(1, length(x) + 1), lambda j: case when (length(x) - j) % 2 = 1 then {_DOUBLED} else cast(x[j] as integer) end)) % 10 = 0",
    "phone": "length(x) between 9 and 15",
    "ssn": "true",
    "secret": "true",
}
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
} | {k: KINDS[k][1] for k in ("phone", "ssn", "secret")}
#: Remainder by 97 of a string of digits, in blocks that fit a bigint.
_MOD97 = (
    "list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(array_to_string(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), "
    "lambda c: case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end), ''), ''), lambda c: cast(c as bigint))), lambda a, b: (a * 10 + b) % 97) = 1"
)
_LENGTHS = "map {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items()) + "}"


def _sql_score(kind: str) -> str:
    _, _, form, check, words = KINDS[kind]
    around = lambda n: f"lower(right(substr(text, 1, s), {n}) || ' ' || substr(text, e + 1, {n}))"
    count = lambda x: "(" + " + ".join(f"cast(contains({x}, '{w}') as integer)" for w in words) + ")"
    score = (
        f"least(100, {form + check} + case when {count(around(NEAR))} > 0 then {NEAR_POINTS} when {count(around(CONTEXT))} > 0 then {FAR_POINTS} else 0 end"
        f" + case when {count(around(CONTEXT))} > 1 then {MORE_POINTS} else 0 end)"
    )
    if kind in ("ssn", "secret"):
        score = f"case when regexp_matches(right(substr(text, 1, s), 1) || substr(text, e + 1, 1), '[A-Za-z0-9]') then 0 else {score} end"
    return score


def _sql_found(kind: str) -> str:
    """(row, s, e) of the confirmed matches of a kind."""
    if kind != "iban":
        return rf"""
{kind}_m as (
  select row, unnest(found) as m, unnest(parts[1:len(found)]) as before, unnest(range(len(found))) as i
  from (select row, regexp_extract_all(text, '{_PLAIN[kind]}') as found, string_split_regex(text, '{_PLAIN[kind]}') as parts from d) where len(found) > 0
), {kind}_at as (
  select row, m, {_DIGITS} as x, cast(sum(length(before) + length(m)) over (partition by row order by i) as bigint) as e from {kind}_m
), {kind}_f as (
  select row, e - length(m) as s, e from {kind}_at where {_CHECKS[kind]}
)"""
    start = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}"
    return rf"""
iban_c as (
  select row, i as s, regexp_extract(substr(text, i + 1, 80), '^{KINDS["iban"][1]}') as found
  from (select row, text, unnest(range(length(text))) as i from d where regexp_matches(text, '{start}'))
  where regexp_matches(substr(text, i + 1, 40), '^{start}') and not regexp_matches(substr(text, i, case when i = 0 then 0 else 1 end), '[A-Za-z0-9]')
), iban_e as (
  select *, substr(found, 1, cast(n as bigint)) as m from (select *, unnest(range(15, length(found) + 1)) as n from iban_c)
), iban_n as (
  select row, s, max((by_country, n)) as best from (
    select *, coalesce(length(replace(m, ' ', '')) = {_LENGTHS}[left(m, 2)], false) as by_country from iban_e
    where m[-1] <> ' ' and length(replace(m, ' ', '')) >= 15 and {_MOD97}
  ) where by_country or substr(found, cast(n as bigint) + 1, 1) in ('', ' ') group by row, s
), iban_f as (
  select row, p[1] as s, p[2] as e from (
    select row, unnest(list_reduce(list([[s, s + best[2]]] order by s), lambda a, b: case when b[1][1] >= a[-1][2] then a || b else a end)) as p from iban_n group by row
  )
)"""


def _sql_kind(kind: str) -> str:
    keep = 0 if kind in BASE else KEEP
    return rf"""{_sql_found(kind)}, {kind} as (
  select row, string_agg('{kind}:' || s || ':' || e, ',' order by s) as s, string_agg(cast(score as varchar), ',' order by s) as p, count(*) as n
  from (select row, s, e, {_sql_score(kind)} as score from {kind}_f join d using (row)) where score >= {keep} group by row
)"""


OP7_SQL = (
    "with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents), "
    + ", ".join(map(_sql_kind, KINDS))
    + "\nselect d.doc_id, "
    + ", ".join(f"coalesce({k}.n, 0) as n_{k}" for k in BASE)
    + ", sha256(concat_ws(',', "
    + ", ".join(f"{k}.s" for k in BASE)
    + ")) as base_sha256, concat_ws(',', "
    + ", ".join(f"{k}.s" for k in KINDS)
    + ") as spans, concat_ws(',', "
    + ", ".join(f"{k}.p" for k in KINDS)
    + ") as scores from d "
    + " ".join(f"left join {k} on d.row = {k}.row" for k in KINDS)
)
