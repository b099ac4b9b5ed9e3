"""Documents with every awkward case, and plain references."""

import re
from collections import Counter

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("size", "band", "row", "keep_id")]
)
LOREM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near the river bank and say nothing at all today".split()


def prose(seed: int, n: int = 60) -> str:
    return " ".join(LOREM[(seed * 7 + i * (seed % 5 + 1)) % len(LOREM)] + (str(i * seed) if i % 6 == 0 else "") for i in range(n))


def awkward():
    """(doc_id, text, lang, source, n_chars) rows: nulls, empties, repeats, ties, long texts."""
    texts = [prose(k) for k in range(1, 12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(20, texts[0], "en", "s0", 1), (21, texts[0] + " Extra Words here", None, None, None), (22, texts[1].upper(), "en", "s1", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "", 0), (32, " \n\t ", "en", "s1", 3), (33, "one", "en", "s9", 3), (34, "ONE", "en", "s9", 3), (35, "a b c d", "en", None, 7)]
    rows += [(40, texts[2], "en", "s2", 1), (40, texts[2], "en", "s2", 1), (None, texts[3], "en", "s0", 1), (None, "alone", None, None, None), (40, "same id other text " + texts[4], "en", "s2", 1)]
    rows += [(50, "x" * 40000 + " " + "word " * 3000, "en", "s1", 1), (51, "é 日本 ünï  code point", "fr", "s1", 1)]
    return rows


def documents(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def multiset(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())
