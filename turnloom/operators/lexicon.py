"""Lexicon joins: exact entries win, else an entry contained in the token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_tokens(tokens: DataFrame, lexicon: DataFrame, last: bool = True) -> DataFrame:
    """(tok, entry): for each distinct token its exact entry, else of the partial entries that it
    contains the last (or first) in lexicon order.

    Tokens come distinct; exact entries by equi-join.  Partial entries have no key to join by, so
    the token's substrings of the entries' lengths make one: the join stays an equi-join."""
    toks = tokens.select("tok").distinct()
    exact = toks.join(lexicon.where("not partial").select(F.col("word").alias("tok"), F.col("ord")), "tok")
    part = lexicon.where("partial").select(F.col("word").alias("sub"), F.col("ord"))
    lengths = part.select(F.array_sort(F.collect_set(F.length("sub"))).alias("ns"))  # few numbers, one row
    subs = toks.crossJoin(F.broadcast(lengths)).select("tok", F.explode(_substrings("tok", "ns")).alias("sub"))
    hits = subs.distinct().join(part, "sub").groupBy("tok").agg((F.max if last else F.min)("ord").alias("ord"))
    found = exact.groupBy("tok").agg(F.min("ord").alias("ord"))
    return found.unionByName(hits.join(found.select("tok"), "tok", "left_anti"))


def _substrings(tok: str, lengths: str):
    of = lambda n: F.when(n <= F.length(tok), F.transform(F.sequence(F.lit(1), F.length(tok) - n + 1), lambda i: F.substring(F.col(tok), i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.col(lengths), of)))
