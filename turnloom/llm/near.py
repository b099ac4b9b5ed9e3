"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds its distinct 5-word shingles (A-Z lower-cased) as 64-bit fingerprints.
Equal sets are one *class*, known by a 128-bit digest, so copies are collapsed before anything is
compared.  A class's sketch has ``REGISTERS`` buckets; each keeps the leading-zero count and
``MANTISSA`` bits of its smallest hash, 16 bits in all; empty buckets take the register of the
first filled bucket in an order of their own.  Bands of ``BAND`` compressed registers are the
candidate keys.

Within a bucket every class is paired with the bucket's smallest class (a star, never all pairs).
Pairs whose sketches, after correction for accidental register collisions, are ``MARGIN`` standard
errors below the threshold are put aside; the others are verified on full sets of words, not of
fingerprints.  First each class is verified against its likeliest partner, then the pairs that
still lie in different components, then those of a second star around the bucket's most central
class, the one with the most company over all its buckets: the middle of a group of near copies.
Last, so that no link is lost, come pairs that no star edge joined: those with a rare shingle in
common, and those of one bucket whose frequent shingles may suffice for a link, by a bound that is
never too low.
Components come from alternating large-star and small-star rounds over tables, each time from the
old labels and the new links.  A table is deleted after its last reader; the result is a table of
its own that stays until the shared folder is cleaned.

Edge cases: no words or null text: an empty set, linked with nothing; under five words the whole
sequence is the one shingle; rows may repeat ids or have null ids (a component's id is its
smallest id; a row is kept if its id equals it, null with null); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.store import by_input, in_files, materialize, release, small_batches, sweep, unused
from turnloom.llm.words import LOWER, U64, WORD, Block, blocks, mix, text_block, windows

SHINGLE, THRESHOLD = 5, 0.75
REGISTERS, BAND, MANTISSA, MARGIN = 128, 4, 10, 5.0
RARE, BLOCKS, SALTS = 4, 64, 16
_BITS = REGISTERS.bit_length() - 1
_WORDS = re.compile(WORD.encode())
_rng = np.random.default_rng(7)
#: For each bucket the order in which buckets are tried for a register, itself first.
_ORDER = np.stack([np.concatenate(([i], _rng.permutation(np.delete(np.arange(REGISTERS), i)))) for i in range(REGISTERS)])
_EDGES = (np.arange(REGISTERS, dtype=np.uint64) << U64(64 - _BITS)).astype(np.uint64)


def shingle_sets(block: Block) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text of a block."""
    hashes, bounds = block.word_hashes()
    grams, at = windows(hashes, bounds, SHINGLE)
    n = np.diff(bounds)
    for i in range(block.n):
        if n[i] >= SHINGLE:
            yield np.unique(grams[at[i] : at[i + 1]])
        elif n[i]:
            total = np.array([n[i]], np.uint64)
            for h in hashes[bounds[i] : bounds[i + 1]]:
                total = mix(total ^ h)
            yield total
        else:
            yield np.zeros(0, np.uint64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Compressed registers of a set that is not empty, as 16-bit words."""
    at = np.searchsorted(values, _EDGES)
    filled = np.concatenate((at[1:], [len(values)])) > at
    low = (values[np.minimum(at, len(values) - 1)] << U64(_BITS)).astype(np.float64)
    part, power = np.frexp(low)
    zeros = np.clip(64 - power, 0, 63)
    zeros[low == 0] = 63
    code = (zeros << MANTISSA) | np.clip((part * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    source = _ORDER[np.arange(REGISTERS), np.argmax(filled[_ORDER], axis=1)]
    return code[source].astype(np.uint16)


def chance(n: np.ndarray) -> np.ndarray:
    """Share of registers per leading-zero count in a set of size n (rows), for collisions."""
    per = np.maximum(n[:, None] / REGISTERS, 1.0)
    up = np.ldexp(1.0, -np.arange(64))[None, :]
    return (1 - up / 2) ** per - (1 - up) ** per


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard from matching registers, less those expected to match by accident."""
    same = (a == b).mean(axis=1)
    accident = (chance(n_a) * chance(n_b)).sum(axis=1) / (1 << MANTISSA)
    return np.clip((same - accident) / (1 - accident), 0, 1)


def linked(a, b) -> bool:
    """100 * intersection >= 75 * union, of two sets of any kind."""
    if not a or not b or 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    w = _WORDS.findall(text.translate(LOWER.tobytes()))
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else ({tuple(w)} if w else set())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, block in blocks(batch.column(2)):
            digests, sizes, codes = [], [], []
            for values in shingle_sets(block):
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                codes.append(sketch(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary())], ["doc_id", "text_md5", "set_id", "n_shingles", "sketch"]
            )


def _md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5, set_id (null if empty), n_shingles and sketch of every row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", _md5().alias("text_md5"), "text").mapInArrow(_sketches, "doc_id bigint, text_md5 string, set_id binary, n_shingles bigint, sketch binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = REGISTERS // BAND
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, n, BAND)
        packed = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, n)
        with np.errstate(over="ignore"):
            packed = mix(packed ^ mix(np.arange(1, n + 1, dtype=np.uint64))[None, :])
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
        yield pa.RecordBatch.from_arrays([pa.array(packed.reshape(-1).view(np.int64)), ids], ["band", "set_id"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
        n_a, n_b = (batch.column(k).to_numpy() for k in (4, 5))
        found = estimate(a, b, n_a, n_b)
        size = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * 75
        fine = size & (found >= THRESHOLD - MARGIN * np.sqrt(THRESHOLD * (1 - THRESHOLD) / REGISTERS))
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "likely"])
        yield out.filter(pa.array(fine))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked on full sets.  A text whose digest is not its class's is passed over.

    Fingerprints rule pairs out; what they let through is decided by the shingles themselves."""
    last: tuple[bytes, np.ndarray | None, set | None] = (b"", None, None)

    def full(set_id: bytes, text: bytes) -> np.ndarray | None:
        values = next(shingle_sets(text_block(text)))
        return values if hashlib.blake2b(values.tobytes(), digest_size=16).digest() == set_id else None

    def may(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= 75 * (len(a) + len(b) - both)

    for batch in batches:
        a, b = [], []
        for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last[0] != y:
                last = (y, full(y, ty), None)
            if last[1] is None or (mine := full(x, tx)) is None or not may(mine, last[1]):
                continue
            if last[2] is None:
                last = (*last[:2], shingles(ty))
            if linked(shingles(tx), last[2]):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, block in blocks(batch.column(1)):
            for k, values in enumerate(shingle_sets(block)):
                at = batch.column(0).slice(i + k, 1).take(pa.array(np.zeros(len(values), np.int64)))
                yield pa.RecordBatch.from_arrays([at, pa.array(values.view(np.int64))], ["x", "shingle"])


class _Links:
    """Verification of candidate pairs and the components that follow."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.texts: DataFrame | None = None
        self.labels: DataFrame | None = None

    def likely(self, pairs: DataFrame, n: int) -> DataFrame:
        """Those of up to ``n`` pairs (a, b) that the sketches do not rule out, with their estimate."""
        s = self.classes.select("set_id", "sketch", "n_shingles")
        both = pairs.join(s.toDF("a", "sketch_a", "n_a"), "a").join(s.toDF("b", "sketch_b", "n_b"), "b")
        found = both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(_estimated, "a binary, b binary, likely double")
        return materialize(in_files(found, n), "likely")

    def fetch(self, members: DataFrame) -> None:
        """Keep the texts of all classes that share a bucket: one row's text stands for its class."""
        ids = members.select("x").distinct().withColumnRenamed("x", "set_id")
        ids = ids.join(self.classes.select("set_id", "first_id", "first_md5"), "set_id")
        text = self.docs.select(F.col("doc_id").alias("d"), _md5().alias("m"), F.col("text").cast("binary").alias("content"))
        found = text.join(ids, text["d"].eqNullSafe(ids["first_id"]) & (text["m"] == ids["first_md5"])).select("set_id", "content")
        self.texts = materialize(by_input(found, self.docs), "texts")
        del found, text, ids
        sweep(self.docs.sparkSession)

    def verify(self, pairs: DataFrame, n: int) -> None:
        """Add the links among up to ``n`` pairs to the components."""
        t = self.texts
        with_a = pairs.select("a", "b").join(t.toDF("a", "content_a"), "a")
        with_b = with_a.join(t.toDF("b", "content_b"), "b").select("a", "b", "content_a", "content_b")
        new = materialize(in_files(with_b.mapInArrow(_verified, "a binary, b binary"), n, 1 << 12), "links")
        before = self.labels
        self.labels = components(new if before is None else new.union(before), new.count() + (before.count() if before is not None else 0))
        release(new, *([before] if before is not None else []))
        sweep(self.docs.sparkSession)

    def crossing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components; a class without links is its own."""
        if self.labels is None:
            return pairs
        l = self.labels  # noqa: E741
        p = pairs.join(l.toDF("a", "c_a"), "a", "left").join(l.toDF("b", "c_b"), "b", "left")
        return p.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def components(edges: DataFrame, n: int) -> DataFrame:
    """(node, component) of ``n`` edges: component is the smallest node reached; a table of its own.

    Large-star and small-star rounds until nothing moves; a node's neighbours are never
    gathered, only their minimum, and each round is a table of its own."""
    u, v = edges.columns
    e = materialize(edges.select(F.greatest(u, v).alias("node"), F.least(u, v).alias("component")).where("node != component").distinct().transform(in_files, n), "cc")
    before = None
    while True:
        both = e.union(e.select("component", "node"))
        low = both.groupBy("node").agg(F.least(F.min("component"), F.col("node")).alias("m"))
        large = both.where("component > node").join(low, "node").select(F.col("component").alias("node"), F.col("m").alias("component"))
        large = materialize(large.where("node != component").distinct().transform(in_files, 2 * n), "cc")
        low = large.groupBy("node").agg(F.min("component").alias("m"))
        small = large.join(low, "node").select(F.explode(F.array(F.struct(F.col("node"), F.col("m").alias("component")), F.struct(F.col("component").alias("node"), F.col("m").alias("component")))).alias("p"))
        small = materialize(small.select("p.*").where("node != component").distinct().transform(in_files, 2 * n), "cc")
        now = small.agg(F.count("*"), F.expr("bit_xor(xxhash64(node, component))")).first()
        release(large, e)
        e, n, same, before = small, now[0], now == before, now
        if same:
            return e


def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_md5."""
    rows = materialize(by_input(sketched(docs), docs), "sketches")
    classes = rows.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("text_md5", "doc_id"), F.min("text_md5")).alias("first_md5"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")
    )
    classes = materialize(in_files(classes, rows.count(), 1 << 13), "classes")
    most = REGISTERS // BAND * classes.count()
    bands = classes.select("set_id", "sketch").mapInArrow(_bands, "band bigint, set_id binary")
    heads = bands.groupBy("band").agg(F.min("set_id").alias("b"), F.max("set_id").alias("top"), F.count("*").alias("k")).where("b != top").drop("top")
    members = materialize(in_files(bands.join(heads, "band").select("band", F.col("set_id").alias("x"), "b", "k"), most, 1 << 17), "members")
    work = _Links(docs, classes)
    n = members.count()
    if n:
        work.fetch(members)
        star = work.likely(members.where("x != b").select(F.col("x").alias("a"), "b").distinct(), n)
        if pairs := star.count():
            best = star.groupBy("a").agg(F.max_by("b", F.struct("likely", "b")).alias("b"))
            work.verify(best, pairs)
            work.verify(work.crossing(star).join(best, ["a", "b"], "left_anti"), pairs)
        again = work.likely(work.crossing(_second_star(members)), n)
        if pairs := again.count():
            work.verify(again, pairs)
        release(star, again)
        _rest(members, n, work)
        release(work.texts)
    release(members)
    named = _named(classes, work.labels)
    out = rows.join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_md5")
    out = materialize(in_files(out, rows.count()), "near")
    release(rows, classes, *([work.labels] if work.labels is not None else []))
    return out


def _named(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(set_id, component_id): the smallest doc_id of each class's component.

    Linked classes meet their component's id over ``SALTS`` salts: one component may hold a third of all."""
    first = classes.select("set_id", "first_id")
    if labels is None:
        return first.select("set_id", F.col("first_id").alias("component_id"))
    own = labels.select("component").distinct().select(F.col("component").alias("set_id"), "component")
    linked_to = labels.select(F.col("node").alias("set_id"), "component").union(own)
    at = first.join(linked_to, "set_id", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    least = at.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least")).select("component", "least", salts)
    salted = at.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["component", "salt"], "left").select("set_id", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("least")).alias("component_id"))


def _second_star(members: DataFrame) -> DataFrame:
    """Pairs of each class with its bucket's most central class, the one of most company in all its buckets."""
    degree = members.groupBy("x").agg(F.sum("k").alias("mates"))
    at = members.select("band", "x").join(degree, "x")
    heads = at.groupBy("band").agg(F.max_by("x", F.struct("mates", "x")).alias("h"))
    return members.select("band", "x").join(heads, "band").where("x != h").select(F.greatest("x", "h").alias("a"), F.least("x", "h").alias("b")).distinct()


def _rest(members: DataFrame, n_members: int, work: _Links) -> None:
    """Verify pairs whose components differ after all star edges, if they can be linked at all.

    Buckets with several components take part.  Shingles that at most ``RARE`` of their classes have
    pair their classes.  Two classes without such a shingle in common share only frequent ones; these
    are counted in ``BLOCKS`` blocks by hash, and the sum over blocks of the smaller counts bounds what
    two classes share.  Classes outside their bucket's largest component meet the bucket's others, and
    a pair is made only if its bound reaches a link."""
    labels = work.labels
    named = members.select("band", "x")
    named = named.join(labels.toDF("x", "c"), "x", "left").withColumn("c", F.coalesce("c", "x")) if labels is not None else named.withColumn("c", F.col("x"))
    per = named.groupBy("band", "c").agg(F.count("*").alias("k"))
    mixed = per.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max_by("c", F.struct("k", "c")).alias("main")).where("low <> high").select("band", "main")
    m = materialize(in_files(named.join(mixed, "band"), n_members, 1 << 17), "mixed")
    if not m.isEmpty():
        sizes = work.classes.select(F.col("set_id").alias("x"), F.col("n_shingles").alias("n"))
        own = materialize(in_files(m.select("x", "c").distinct().join(sizes, "x"), n_members, 1 << 17), "own")
        rows = work.texts.join(own.select(F.col("x").alias("set_id")), "set_id").mapInArrow(_shingle_rows, "x binary, shingle bigint")
        rows = materialize(by_input(rows, work.docs), "shingles")
        times = rows.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
        rare = rows.join(times.where(F.col("k") <= RARE).select("shingle"), "shingle").join(own, "x")
        fits = "c <> c_y and 4 * least(n, n_y) >= 3 * greatest(n, n_y)"
        pairs = rare.join(rare.toDF("y", "shingle", "c_y", "n_y"), "shingle").where(f"x > y and {fits}").select(F.col("x").alias("a"), F.col("y").alias("b"))
        block = rows.join(times.where(F.col("k") > RARE).select("shingle"), "shingle").groupBy("x", F.pmod("shingle", F.lit(BLOCKS)).alias("at")).agg(F.count("*").cast("int").alias("k"))
        block = block.groupBy("x").agg(F.sum("k").alias("f"), F.map_from_entries(F.collect_list(F.struct("at", "k"))).alias("at"))
        counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("at"), i), F.lit(0)))
        known = own.join(block, "x").where("4 * f >= 3 * n").select("x", "c", "n", "f", counts.alias("counts"))
        there = m.select("band", "x", "main").join(known, "x")
        outside = there.where("c <> main").select("band", "x", "c", "n", "f", "counts")
        bound = "aggregate(zip_with(counts, counts_y, (p, q) -> least(p, q)), 0L, (s, p) -> s + p)"
        others = there.select("band", *[F.col(k).alias(v) for k, v in (("x", "y"), ("c", "c_y"), ("n", "n_y"), ("f", "f_y"), ("counts", "counts_y"), ("main", "main_y"))])
        both = outside.join(others, "band").where(f"{fits} and (c_y = main_y or x > y) and 7 * least(f, f_y) >= 3 * (n + n_y) and 7 * {bound} >= 3 * (n + n_y)")
        more = work.likely(pairs.union(both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct(), n_members)
        if n := more.count():
            work.verify(more, n)
        release(own, rows, more)
    release(m)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_md5")


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns; of repeated rows, one."""
    mark, one = unused(docs, "mark"), unused(docs, "id")
    kept = near_components(docs).where("kept").select(F.col("doc_id").alias(one), F.col("text_md5").alias(mark)).distinct()
    same = F.col("l.doc_id").eqNullSafe(F.col(f"r.{one}")) & (F.col(f"l.{mark}") == F.col(f"r.{mark}"))
    stay = docs.withColumn(mark, _md5()).alias("l").join(kept.alias("r"), same, "left_semi")
    return by_input(stay.dropDuplicates(["doc_id", mark]).select(*docs.columns), docs)
