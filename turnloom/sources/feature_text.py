"""Text formats of labelled feature rows.  Inputs are (pos, value): ``numbered`` reads them from files.

Order lives in ``pos``.  Sections and sequences are found from the few marker lines, or by a
blocked running sum, never by a sort of all lines in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.order import running_sum
from turnloom.sources.shared import written

SPACES = r"[ \t]+"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 1) and value of the lines of text files, files in order of their names.

    gz and bz2 files are read by their suffix."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("m"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    raw = written(raw.withColumn("p", F.shiftright("m", 33)), "lines")
    blocks = raw.groupBy("p", "file", "at").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    from pyspark.sql.window import Window

    before = F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("p", "file", "at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(blocks, ["p", "file", "at"]).select((F.col("before") + F.col("m") - F.col("first") + 1).alias("pos"), "value")


def sections(lines: DataFrame) -> DataFrame:
    """Add ``split``: train, dev after the line DEV, test after the line TEST; markers go."""
    marks = lines.where(F.col("value").isin("DEV", "TEST")).agg(F.min(F.when(F.col("value") == "DEV", F.col("pos"))).alias("d"), F.min(F.when(F.col("value") == "TEST", F.col("pos"))).alias("t"))
    split = F.when(F.col("pos") > F.col("t"), "test").when(F.col("pos") > F.col("d"), "dev").otherwise("train")
    return lines.crossJoin(F.broadcast(marks)).where(~F.col("value").isin("DEV", "TEST")).select("pos", split.alias("split"), "value")  # marks: one row


def words(value: Column) -> Column:
    return F.filter(F.split(value, SPACES), lambda x: x != "")


def binary_rows(lines: DataFrame) -> DataFrame:
    """label and the set of feature names."""
    w = words(F.col("value"))
    return lines.withColumn("w", w).withColumn("label", F.get("w", F.lit(0))).withColumn("feats", F.sort_array(F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))))).drop("w", "value")


def real_rows(lines: DataFrame) -> DataFrame:
    """pos, name, value: name-value pairs after the label; of repeated names the last counts."""
    w = lines.select("pos", words(F.col("value")).alias("w"))
    pairs = w.select("pos", F.explode(F.sequence(F.lit(1), F.floor((F.size("w") - 1) / 2))).alias("k"), "w").select("pos", "k", F.get("w", (2 * F.col("k") - 1).cast("int")).alias("name"), F.get("w", (2 * F.col("k")).cast("int")).cast("double").alias("value"))
    return pairs.groupBy("pos", "name").agg(F.max_by("value", "k").alias("value"))


def weighted_rows(lines: DataFrame) -> DataFrame:
    """Modifiers after the label: a weight, a task, a domain mark; comments start with ``#``."""
    v = F.trim(F.regexp_replace("value", "#.*$", ""))
    out = lines.select("pos", v.alias("v")).where("v <> ''")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("v", r"\$\$\$WEIGHT[ \t]+[^ \t]+", " "), r"\$\$\$TASK[ \t]+[^ \t]+", " "), r"\$\$\$OUTOFDOMAIN", " ")
    w = words(body)
    return out.select(
        "pos",
        F.get(w, F.lit(0)).alias("label"),
        F.coalesce(F.nullif(F.regexp_extract("v", r"\$\$\$WEIGHT[ \t]+([^ \t]+)", 1), F.lit("")).cast("double"), F.lit(1.0)).alias("weight"),
        F.coalesce(F.nullif(F.regexp_extract("v", r"\$\$\$TASK[ \t]+([^ \t]+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("task"),
        F.contains("v", F.lit("$$$OUTOFDOMAIN")).alias("ood"),
        F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("feats"),
    )


def valued(rows: DataFrame) -> DataFrame:
    """The rows of ``weighted_rows`` with names and values in turn, one feature a row; a name without a value is an error."""
    odd = F.assert_true(F.size("feats") % 2 == 0, "a feature has no value")
    pairs = F.transform(F.filter("feats", lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("name"), F.get("feats", 2 * i + 1).cast("double").alias("value")))
    return rows.withColumn("odd", odd).where("odd is null").select("pos", "label", "weight", "task", "ood", F.inline(pairs))


def explicit_rows(lines: DataFrame) -> DataFrame:
    """One feature list per class, separated by a lone ``#``, each with the class's bias."""
    parts = F.split("value", r"[ \t]+#[ \t]*", -1)
    head = lines.select("pos", F.get(parts, F.lit(0)).alias("label"), F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("class", "body"))
    return head.select("pos", F.trim("label").alias("label"), "class", F.concat(words(F.col("body")), F.array(F.concat(F.lit("**BIAS**"), F.col("class").cast("string"), F.lit("**")))).alias("feats"))


def file_ranges(lines: DataFrame, ranges: str) -> DataFrame:
    """Rows of ``1-5,9,20-end`` or ``all``."""
    keep = F.lit(ranges == "all")
    for r in [] if ranges == "all" else ranges.split(","):
        a, _, b = r.partition("-")
        keep = keep | (F.col("pos") >= int(a)) & (F.lit(True) if b == "end" else F.col("pos") <= int(b or a))
    return lines.where(keep)


def crf_items(lines: DataFrame) -> DataFrame:
    """seq, pos, label, attr, scale: tab-separated attributes ``name[:scale]`` with ``\\:`` and
    ``\\\\`` escapes; an empty line ends a sequence, what follows a ``#`` field is a comment."""
    seq = running_sum(lines, "pos", F.when(F.col("value") == "", 1).otherwise(0), "seq").where("value <> ''")
    fields = F.split("value", "\t", -1)
    items = seq.select("seq", "pos", F.get(fields, F.lit(0)).alias("label"), F.explode(F.filter(F.slice(fields, F.lit(2), F.size(fields)), lambda x: (x != "") & ~x.startswith("#"))).alias("a"))
    # the scale follows the first colon that no backslash escapes
    name = F.regexp_extract("a", r"^((?:[^:\\]|\\.)*)(?::(.*))?$", 1)
    scale = F.regexp_extract("a", r"^((?:[^:\\]|\\.)*)(?::(.*))?$", 2)
    return items.select("seq", "pos", "label", F.regexp_replace(name, r"\\(.)", "$1").alias("attr"), F.coalesce(F.nullif(scale, F.lit("")).cast("double"), F.lit(1.0)).alias("scale"))


def label_groups(text: str, spark: SparkSession) -> DataFrame:
    """label, gid, sub of groups separated by empty lines; a small table by nature."""
    rows = [(m, g, s) for g, group in enumerate(text.strip().split("\n\n")) for s, m in enumerate(group.split())]
    return spark.createDataFrame(rows, "label string, gid int, sub int")


def grammar_rules(lines: DataFrame) -> DataFrame:
    """``[weight [a [b]]] X --> Y ...``; weights of 0 or less become 1."""
    m = r"^\s*(?:([0-9.eE+-]+)\s+(?:([0-9.eE+-]+)\s+(?:([0-9.eE+-]+)\s+)?)?)?(\S+)\s+-->\s+(.*)$"
    part = lambda i: F.nullif(F.regexp_extract("value", m, i), F.lit(""))
    w = part(1).cast("double")
    return lines.where(F.contains("value", F.lit("-->"))).select("pos", F.when(w > 0, w).otherwise(1.0).alias("weight"), part(2).cast("double").alias("a"), part(3).cast("double").alias("b"), part(4).alias("parent"), F.trim(part(5)).alias("children"))


def category_lexicon(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name) and (word, partial, ord, ids) of a ``%``-delimited category dictionary.

    ``word*`` is partial; entries with ``<of>`` or ``(`` keep the word without categories."""
    marks = lines.where("value = '%'").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    at = lines.crossJoin(F.broadcast(marks)).where("value <> '%' and trim(value) <> ''")  # marks: one row
    f = F.split("value", r"\s+")
    names = at.where("pos > a and pos < b").select(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).alias("name"))
    odd = F.contains("value", F.lit("<of>")) | F.contains("value", F.lit("("))
    ids = F.when(odd, F.array().cast("array<string>")).otherwise(F.slice(f, F.lit(2), F.size(f)))
    word = F.get(f, F.lit(0))
    return names, at.where("pos > b").select(F.rtrim(word, F.lit("*")).alias("word"), word.endswith("*").alias("partial"), F.col("pos").alias("ord"), ids.alias("ids"))


def subjectivity_lexicon(lines: DataFrame) -> DataFrame:
    """word, pos_tag, kind, polarity, stemmed from ``k=v`` rows; a later row of a word and tag wins."""
    m = F.str_to_map(F.regexp_replace("value", r"(^|\s)m(\s|$)", " "), F.lit(" "), F.lit("="))
    kv = lines.select("pos", m.alias("m")).select("pos", *[F.col("m")[k].alias(a) for k, a in (("word1", "word"), ("pos1", "pos_tag"), ("type", "kind"), ("priorpolarity", "polarity"), ("stemmed1", "stem"))])
    ok = kv.where("stem in ('y', 'n', '1')").withColumn("stemmed", F.col("stem") == "y")
    last = ok.groupBy("word", "pos_tag").agg(F.max_by(F.struct("kind", "polarity", "stemmed"), "pos").alias("x"))
    return last.select("word", "pos_tag", "x.*")
