r"""Line dedup by a log-template tree of fixed depth.

A line's words are masked (a word with a digit becomes ``<*>``); the tree's levels are the word
count and the first ``DEPTH`` masked words, its leaves hold lines.  Within a leaf every later word
has a count, that of the leaf's different masked lines with the word at that place.  A line's level
is the largest count that at least ``SIMILAR`` tenths of its later words reach: words of that count
or more stay in its template and the others become fields.  A level of one has no partner, and the
line stands for itself.  The level is the line's own, so it grows with the template's lines and not
with the leaf: values of a field that come back by chance stay fields at every size.  A field whose
value is as common as the fixed words counts as fixed, and each such value has its own template.

A template seen in two documents or more recurs, and its lines are dropped from all documents but
the one with the smallest doc_id.  Lines of ``DEPTH`` words or fewer have no template beyond their
path in the tree and are kept.

Lines are masked once for their keys, kept as hashes with their positions, and once more for the words of leaves with several documents and several lines.  Lines are dropped
by position.  A line that a third of all documents share meets its decision over ``SALTS`` salts.

Edge cases: null text has one empty line; ids that are null are no document of their own, and
recurring lines are dropped from their rows; repeated rows share their decisions; of ties the
smallest doc_id keeps a template; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.store import materialize, release
from turnloom.llm.words import let

DEPTH, SIMILAR, SALTS = 3, 6, 8


def masked(rows: DataFrame, line: str) -> DataFrame:
    """Rows with ``masked``: the line's words joined by one space, those with a digit as ``<*>``.

    Each word is passed over once.  Lines without runs of white space, or without digits, skip the
    pattern that looks for them.  The explode keeps filters on the outcome from working it out again."""
    odd = F.lit(False)
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(c))
    plain = rows.withColumn(line, F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(F.col(line))))
    return plain.withColumn("masked", F.explode(F.array(F.when(F.col(line).rlike("[0-9]"), F.regexp_replace(line, r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+", "<*>")).otherwise(F.col(line)))))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and each line of more than ``DEPTH`` words: at, masked, leaf, line."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = masked(text.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "plain")), "plain")
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("n", n).where(F.col("n") > DEPTH).select(
        "doc_id", "text_hash", "at", "masked", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"), F.xxhash64("masked").alias("line")
    )


def templates(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(leaf, line, template, a, b): every line of leaves with several documents and several lines.

    ``keyed`` has the lines' hashes; their words are read from ``docs``, once a line."""
    per_leaf = keyed.groupBy("leaf").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("line").alias("low"), F.max("line").alias("high"))
    leaves = materialize(per_leaf.where("a <> b").select("leaf", (F.col("low") != F.col("high")).alias("several"), "low", "a", "b"), "leaves")
    alone = leaves.where("not several").select("leaf", F.col("low").alias("line"), F.col("low").alias("template"), "a", "b")
    open_leaves = leaves.where("several").select("leaf")
    lines = _lines(docs).select("doc_id", "leaf", "line", "masked").join(open_leaves, "leaf", "left_semi")
    lines = materialize(lines.groupBy("leaf", "line").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.first("masked").alias("masked")), "lines")
    words = lines.select("leaf", "line", F.posexplode(F.split("masked", " ")).alias("at", "word")).where(F.col("at") >= DEPTH)
    words = words.select("line", "at", F.xxhash64("leaf", "at", "word").alias("word"))
    times = words.groupBy("word").agg(F.count("*").alias("c")).where("c > 1")
    counted = words.join(times, "word").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("at", "word", "c"))).alias("words"))
    need = F.floor((SIMILAR * (F.size(F.split("masked", " ")) - DEPTH) + 9) / 10).cast("int")
    level = F.get(F.sort_array(F.transform("words", lambda w: w["c"]), asc=False), F.col("need") - 1)
    fixed = F.transform(F.filter("words", lambda w: w["c"] >= F.col("level")), lambda w: w["word"])
    found = lines.withColumn("need", need).join(counted, "line", "left").withColumn("level", level)
    return alone.unionByName(found.select("leaf", "line", F.when(F.col("level").isNull(), F.col("line")).otherwise(F.xxhash64(F.array_join(F.transform(fixed, lambda w: w.cast("string")), " "))).alias("template"), "a", "b"))


def recurring(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(line, first_doc): masked lines of templates that recur, by hash, with the document that keeps them."""
    lines = materialize(templates(docs, keyed), "templates")
    first = lines.groupBy("leaf", "template").agg(F.min("a").alias("first_doc"), F.max("b").alias("last_doc")).where("first_doc <> last_doc").drop("last_doc")
    out = materialize(lines.join(first, ["leaf", "template"]).select("line", "first_doc"), "recurring")
    release(lines)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left; one row per document."""
    keyed = materialize(_lines(docs).select("doc_id", "text_hash", "at", "leaf", "line"), "keyed")
    found = recurring(docs, keyed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.select("doc_id", "text_hash", "at", "line", F.pmod("text_hash", F.lit(SALTS)).cast("int").alias("salt"))
    hits = salted.join(found, ["line", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "gone")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    both = text.join(gone, text["doc_id"].eqNullSafe(gone["d"]) & (text["text_hash"] == gone["h"]), "left")
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i))
    joined = lambda n, k: F.struct(n.alias("n"), F.size(k).alias("k"), F.array_join(k, "\n").alias("text"))
    left = let(F.split("text", "\n", -1), lambda x: let(stay(x), lambda k: joined(F.size(x), k)))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    out = both.select("doc_id", F.when(F.col("gone").isNull(), F.struct(n.alias("n"), n.alias("k"), F.col("text"))).otherwise(left).alias("left"))
    return out.select("doc_id", F.col("left.n").cast("long").alias("n_lines"), (F.col("left.n") - F.col("left.k")).cast("long").alias("n_dropped"), F.col("left.text").alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates dropped from all documents."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
lines as (
  select row, doc_id, i, line, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g') as masked
  from (select row, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d)
), keyed as (
  select *, len(string_split(masked, ' ')) as n, array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ') as lead from lines
), leaf as (
  select n, lead from keyed where n > {DEPTH} group by n, lead having min(doc_id) <> max(doc_id)
), uniq as (
  select n, lead, masked, min(doc_id) as a, max(doc_id) as b from keyed join leaf using (n, lead) group by n, lead, masked
), words as (
  select n, lead, masked, word, pos, count(*) over (partition by n, lead, pos, word) as c
  from (select n, lead, masked, unnest(string_split(masked, ' ')) as word, unnest(range(n)) as pos from uniq) where pos >= {DEPTH}
), levels as (
  select n, lead, masked, list_sort(list(c), 'DESC')[({SIMILAR} * (n - {DEPTH}) + 9) // 10] as level from words group by n, lead, masked
), kept as (
  select n, lead, masked, string_agg(pos || ':' || word, ' ' order by pos) as pattern from words join levels using (n, lead, masked) where c >= level and level > 1 group by n, lead, masked
), templated as (
  select u.*, case when pattern is not null then 'open ' || pattern else 'line ' || masked end as template from uniq u left join kept using (n, lead, masked)
), firsts as (
  select n, lead, template, min(a) as first_doc from templated group by n, lead, template having min(a) <> max(b)
), found as (
  select masked, first_doc from templated join firsts using (n, lead, template)
), left_over as (
  select row, line, i from keyed k where not exists (select 1 from found f where f.masked = k.masked and f.first_doc is distinct from k.doc_id)
), texts as (
  select row, string_agg(line, chr(10) order by i) as text, count(*) as k from left_over group by row
)
select d.doc_id, cast(len(string_split(d.text, chr(10))) as bigint) as n_lines, len(string_split(d.text, chr(10))) - coalesce(k, 0) as n_dropped,
  cast(length(coalesce(t.text, '')) as bigint) as kept_chars, sha256(coalesce(t.text, '')) as kept_sha256
from d left join texts t using (row)
"""
