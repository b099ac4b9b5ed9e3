"""Windowed features of units: one row in, a set of feature strings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import text as X

def by_dyad():
    return Window.partitionBy("dyad").orderBy("pos")



def _near(col: str, j: int) -> Column:
    """Tokens j rows back (negative) or forward; none past the ends."""
    c = F.lag(col, -j).over(by_dyad()) if j < 0 else F.lead(col, j).over(by_dyad())
    return F.coalesce(c, F.array().cast(X.NONE))


def offsets(back: int, forward: int) -> list[tuple[str, int, int]]:
    return [("BACK", j, -j) for j in range(1, back + 1)] + [("FORWARD", j, j) for j in range(1, forward + 1)]


def near_columns(units: DataFrame, back: int, forward: int, col: str = "toks") -> DataFrame:
    """Add ``_BACK_j`` and ``_FORWARD_j``: one exchange and sort serve all of them."""
    return units.select("*", *[_near(col, at).alias(f"_{side}_{j}") for side, j, at in offsets(back, forward)])


def window_features(units: DataFrame, back: int = 1, forward: int = 1) -> DataFrame:
    """Bag of words of the unit and its neighbours, and the speaker."""
    parts = [F.array(F.concat(F.lit("SPEAKER_"), F.col("role"))), X.tagged("CUR_", F.col("toks"))]
    parts += [X.tagged(f"{side}_{j}_", F.col(f"_{side}_{j}")) for side, j, _ in offsets(back, forward)]
    return near_columns(units, back, forward).select("dyad", "pos", "role", "code", X.joined(F.concat(*parts)).alias("feats"))


def speaker_features(units: DataFrame, back: int = 1, forward: int = 1) -> DataFrame:
    """Speakers around; past the ends the literal None."""
    near = lambda at: F.coalesce(F.lag("role", -at).over(by_dyad()) if at < 0 else F.lead("role", at).over(by_dyad()), F.lit("None"))
    parts = [F.concat(F.lit("CUR_SPEAKER_"), F.col("role"))] + [F.concat(F.lit(f"{side}_{j}_SPEAKER_"), near(at)) for side, j, at in offsets(back, forward)]
    return units.select("dyad", "pos", X.joined(F.array(*parts)).alias("feats"))


def _three(prefix: str, infix: str, toks: Column) -> list[Column]:
    """One to three words, with boundaries: names are PREFIXn_infix."""
    return [X.tagged(f"{prefix}1_{infix}", toks), X.tagged(f"{prefix}2_{infix}", X.ngrams(X.padded(toks, 1), 2, "/")), X.tagged(f"{prefix}3_{infix}", X.ngrams(X.padded(toks, 2), 3, "/"))]


def trigram_features(units: DataFrame) -> DataFrame:
    parts = [F.array(F.concat(F.lit("SPEAKER_"), F.col("role"))), *_three("CUR", "", F.col("toks"))]
    return units.select("dyad", "pos", X.joined(F.concat(*parts)).alias("feats"))


def trigram_window_features(units: DataFrame, back: int = 1, forward: int = 1) -> DataFrame:
    """The same for neighbours too; rows past the ends still have their boundaries."""
    parts = [F.array(F.concat(F.lit("SPEAKER_"), F.col("role"))), *_three("CUR", "", F.col("toks"))]
    for side, j, _ in offsets(back, forward):
        parts += _three(side, f"{j}_", F.col(f"_{side}_{j}"))
    return near_columns(units, back, forward).select("dyad", "pos", X.joined(F.concat(*parts)).alias("feats"))


def skip_features(units: DataFrame, back: int = 1, forward: int = 1, window: int = 5) -> DataFrame:
    """Skip-grams of one to four words; of four-grams the first three words show.

    A unit's grams are worked out once and taken over by its neighbours with another prefix.  Three
    words begin a four-gram if a word is left within the window, so that they are three-grams of a
    window less by one over all words but the last."""

    def grams(t: Column) -> Column:
        four = X.padded(t, 3)
        four = F.slice(four, F.lit(1), F.size(four) - 1)
        return F.array_distinct(F.concat(
            X.tagged("_UNIGRAM_", t), X.tagged("_BIGRAM_", X.skip_grams(X.padded(t, 1), 2, window)), X.tagged("_TRIGRAM_", X.skip_grams(X.padded(t, 2), 3, window)),
            X.tagged("_FOURGRAM_", X.skip_grams(four, 3, window - 1)),
        ))

    past = grams(F.array().cast(X.NONE))  # a row past the ends has its boundaries only
    at = units.select("dyad", "pos", grams(F.col("toks")).alias("_own"))
    near = lambda j: F.coalesce(F.lag("_own", -j).over(by_dyad()) if j < 0 else F.lead("_own", j).over(by_dyad()), past)
    sides = [(f"{side}_{j}", near(k)) for side, j, k in offsets(back, forward)]
    wide = at.select("*", *[c.alias(name) for name, c in sides])
    return wide.select("dyad", "pos", X.joined(F.concat(X.tagged("CUR", F.col("_own")), *[X.tagged(name, F.col(name)) for name, _ in sides])).alias("feats"))


def collocation_features(units: DataFrame, phrases: DataFrame, longest: int, back: int = 0, forward: int = 0) -> DataFrame:
    """Phrases (words joined by ``_``) of three words or more found in units, by a semi-join."""
    toks = X.tokens(F.replace("unit", F.lit("_"), F.lit("")))
    grams = F.concat(*[X.ngrams(toks, n, "_") for n in range(3, longest + 1)])
    hits = units.select("dyad", "pos", F.explode(F.array_distinct(grams)).alias("phrase")).join(phrases.select("phrase").distinct(), "phrase", "left_semi")
    per = hits.groupBy("dyad", "pos").agg(F.collect_set("phrase").alias("found"))
    both = units.select("dyad", "pos").join(per, ["dyad", "pos"], "left").withColumn("found", F.coalesce("found", F.array().cast(X.NONE)))
    parts = [X.tagged("CUR_COLLOC_", F.col("found"))] + [X.tagged(f"{side}_{j}_COLLOC_", F.col(f"_{side}_{j}")) for side, j, _ in offsets(back, forward)]
    return near_columns(both, back, forward, "found").select("dyad", "pos", X.joined(F.concat(*parts)).alias("feats"))


def template_features(items: DataFrame) -> DataFrame:
    """The chunking template over words (w) and tags (p), two items either way; ends are empty."""
    at = {}
    for c in ("w", "p"):
        for j in range(-2, 3):
            v = F.col(c) if j == 0 else F.lag(c, -j).over(by_dyad()) if j < 0 else F.lead(c, j).over(by_dyad())
            at[c, j] = F.coalesce(v, F.lit(""))
    # fixed values: which offsets each feature joins
    spec = [("w", s) for s in ((-2,), (-1,), (0,), (1,), (2,), (-1, 0), (0, 1))]
    tags = [("p", s) for s in ((-2,), (-1,), (0,), (1,), (2,), (-2, -1), (-1, 0), (0, 1), (1, 2))]
    threes = [("p", s) for s in ((-2, -1, 0), (-1, 0, 1), (0, 1, 2))]
    feats = []
    for group, rows in enumerate((spec, tags, threes)):
        feats += [F.concat(F.lit(f"U{group}{k}="), F.concat_ws("/", *[at[c, j] for j in s])) for k, (c, s) in enumerate(rows)]
    return items.select("dyad", "pos", F.array_join(F.array(*feats), "\t").alias("feats"))
