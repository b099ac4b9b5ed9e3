"""From raw transcript lines to coded units, as one lazy plan with a reject channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions.text import let
from turnloom.operators.order import runs

#: The closed tag set with its known misspellings.
TAGS = (
    "OS|OM|IP|IR|IB|SBR|SBE|SF|QP|QR|QB|QS|QM|INN|INP|MU|IDN|IDP|IS|GD|TH|PW|RT|RP|RN|P1|PC|PP|PM|PX|PO|PT|CS|MIN|MIC|MINEG|OT|P!|ESbr|MiC|MINEg|MINeg|MIneg|MiNEG|Min|Mineg|Ib|Pp|SbR|Sbr|Sf|oT|IN N|M INEG|MI N"
)
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
TAG = f"{EDGE}({TAGS}){EDGE}"
HEADER = "^(Name|Group|Date)"


def parse_dyads(lines: DataFrame) -> DataFrame:
    """lineno, dyad and rest; ``reason`` m1 where a line has no dyad and sequence number."""
    v = F.trim("value")
    dyad = F.regexp_extract(v, "^([0-9]+),[0-9]+,", 1)
    return lines.select(
        "lineno", F.when(dyad != "", dyad).alias("dyad"), F.when(dyad != "", F.regexp_replace(v, "^[0-9]+,[0-9]+,", "")).otherwise(v).alias("rest"), F.when(dyad == "", "m1").alias("reason")
    )


def resolve_speakers(parsed: DataFrame) -> DataFrame:
    """Speaker of each line, given or carried forward; lines that switch speakers inside are cut in two.

    The part after a switch always belongs to the second speaker.  ``reason`` m2: no speaker yet,
    m3: several switches.  Header lines are left out."""
    first = F.lower(F.substring("rest", 1, 1))
    named = F.col("rest").rlike("(?i)^(gr|wi)[^,]+,")
    own = F.when(named & (first == "g"), "Grocery").when(named, "Wine")
    body = F.replace(F.when(named, F.regexp_replace("rest", "(?i)^(gr|wi)[^,]+,", "")).otherwise(F.col("rest")), F.lit("-"), F.lit(""))
    ok = parsed.where("reason is null").where(named | ~F.col("rest").rlike(HEADER))
    ok = ok.select("lineno", "dyad", own.alias("own"), body.alias("body"))
    pieces = F.split("body", "Grocery,|Wine,", -1)
    short = (F.length("body") < 10) | (F.size("pieces") == 1) | ((F.size("pieces") == 2) & ((F.length(F.get("pieces", F.lit(0))) < 10) | (F.length(F.get("pieces", F.lit(1))) < 10)))
    ok = ok.withColumn("pieces", pieces).withColumn("kind", F.when(short, "whole").when(F.size("pieces") == 2, "cut").otherwise("m3"))
    ends = F.when(F.col("kind") == "cut", "Wine").when(F.col("kind") == "whole", F.col("own"))
    w = Window.partitionBy("dyad").orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(ends, ignorenulls=True).over(w)
    ok = ok.withColumn("speaker", F.coalesce("own", before))
    reason = F.when(F.col("speaker").isNull(), "m2").when(F.col("kind") == "m3", "m3")
    part = lambda who, text: F.struct(who.alias("speaker"), text.alias("body"))
    parts = F.when(F.col("kind") == "cut", F.array(part(F.col("speaker"), F.get("pieces", F.lit(0))), part(F.lit("Wine"), F.get("pieces", F.lit(1))))).otherwise(F.array(part(F.col("speaker"), F.col("body"))))
    return ok.select("lineno", "dyad", reason.alias("reason"), F.posexplode(parts).alias("part", "p")).select("lineno", "part", "dyad", "p.speaker", "p.body", "reason")


def codes_of(body: Column) -> Column:
    """Tags in a text, normalised; PM goes if other codes but no QR are there."""
    found = F.transform(F.regexp_extract_all(body, F.lit(TAG), F.lit(1)), lambda t: F.replace(F.replace(F.upper(t), F.lit(" "), F.lit("")), F.lit("P!"), F.lit("P1")))
    return let(found, lambda c: F.when(F.array_contains(c, "PM") & (F.size(c) > 1) & ~F.array_contains(c, "QR"), F.array_remove(c, "PM")).otherwise(c))


def units_of(body: Column, n_codes: Column) -> Column:
    """Slash-separated pieces with a letter, digit or question mark; if their number is not that
    of the codes, pieces whose left neighbour ends in a letter or digit are glued back."""
    pieces = F.filter(F.transform(F.split(F.regexp_replace(body, TAG, ""), "/", -1), lambda x: F.trim(x)), lambda x: x.rlike("[a-zA-Z0-9?]"))
    glue = lambda acc, x: F.concat(acc, F.when(acc == "", "").when(acc.rlike("[a-zA-Z0-9]$"), "/").otherwise("\u0001"), x)
    glued = lambda p: F.filter(F.split(F.aggregate(p, F.lit(""), glue), "\u0001", -1), lambda x: x != "")
    return let(pieces, lambda p: F.when(F.size(p) == n_codes, p).otherwise(glued(p)))


def coded(spoken: DataFrame) -> DataFrame:
    ok = spoken.where("reason is null").withColumn("codes", codes_of(F.col("body")))
    return ok.withColumn("units", units_of(F.col("body"), F.size("codes")))


def merged_turns(spoken: DataFrame) -> DataFrame:
    """Runs of lines of one speaker as turns: codes and units in order of the lines."""
    c = coded(spoken).withColumn("at", F.col("lineno") * 2 + F.col("part"))
    r = runs(c, "dyad", "at", "speaker", "turn")
    of = lambda col: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", col))), lambda x: x[col]))
    return r.groupBy("dyad", "turn", "speaker").agg(F.min("lineno").alias("lineno"), of("codes").alias("codes"), of("units").alias("units"))


def aligned(turns: DataFrame) -> DataFrame:
    """One row a unit with its code, for turns with as many units as codes."""
    ok = turns.where(F.size("codes") == F.size("units"))
    return ok.select("dyad", "turn", "speaker", F.posexplode(F.arrays_zip("units", "codes")).alias("k", "z")).select("dyad", "turn", "speaker", "k", F.col("z.units").alias("unit"), F.col("z.codes").alias("code"))


def rejects(parsed: DataFrame, spoken: DataFrame, turns: DataFrame) -> DataFrame:
    """lineno and reason of all that was not taken: m1 to m4."""
    out = parsed.where("reason is not null").select("lineno", "reason")
    out = out.unionByName(spoken.where("reason is not null and part = 0").select("lineno", "reason"))
    return out.unionByName(turns.where(F.size("codes") != F.size("units")).select("lineno", F.lit("m4").alias("reason")))
