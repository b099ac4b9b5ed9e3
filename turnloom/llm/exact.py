"""Exact dedup by Grace hashing.

Records go to buckets by a hash of their text; each task keeps an open-addressing table that
compares complete contents, up to ``table_bytes``.  Contents that find no room are written out,
whole, to spill files in the shared folder, and are dealt again by another hash with more buckets,
until nothing spills.  All copies of a content are in one bucket, and either all enter its table
or none does.  Before the first exchange the same table runs over each input partition, so a group
of any size sends at most one record from a partition.

Edge cases: null text is the empty text; a null doc_id never stays while another id is there (the
largest id stays; ids all null: keep_id null, kept true); rows that repeat the id that stays are
the same record and share its flag (``exact_dedup_stage`` returns one of them); empty tables give
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.store import by_input, materialize, release, small_batches, unused

TABLE_BYTES = 48 << 20
LOCAL = "content binary, keep_id bigint, n bigint"
DEALT = "text_sha256 string, keep_id bigint, n bigint, content binary"


class ContentTable:
    """Open addressing with linear probing; entries hold complete contents."""

    def __init__(self, table_bytes: int, seed: int):
        self.room, self.seed = table_bytes, seed
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def put(self, content: bytes, doc_id: int | None, n: int) -> bool:
        """Count a record; False if its content is new and finds no room."""
        h = xxhash.xxh64_intdigest(content, self.seed)
        i = h & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                self.counts[e] += n
                if doc_id is not None and (self.ids[e] is None or doc_id > self.ids[e]):
                    self.ids[e] = doc_id
                return True
            i = (i + 1) & self.mask
        if self.room < len(content) and self.contents:
            self.room = -1  # from now on no new content enters: a content is in the table or spilled, never both
            return False
        self.room -= len(content) + 64
        self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.ids.append(doc_id)
        self.counts.append(n)
        if 2 * len(self.hashes) > len(self.slots):
            self._widen()
        return True

    def _widen(self) -> None:
        self.slots, self.mask = [-1] * (4 * len(self.slots)), 4 * len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


def _chunks(columns: list[list], kinds: list[pa.DataType], names: list[str], bytes_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    i = 0
    while i < len(columns[0]):
        j, held = i, 0
        while j < len(columns[0]) and (j == i or held + len(columns[bytes_at][j] or b"") <= most) and j - i < 4096:
            held += len(columns[bytes_at][j] or b"")
            j += 1
        yield pa.RecordBatch.from_arrays([pa.array(c[i:j], k) for c, k in zip(columns, kinds, strict=True)], names)
        i = j


def _local(table_bytes: int):
    kinds, names = [pa.binary(), pa.int64(), pa.int64()], ["content", "keep_id", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(table_bytes, 0)
        for batch in batches:
            past: list[list] = [[], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not table.put(text, doc_id, 1):
                    for c, v in zip(past, (text, doc_id, 1), strict=True):
                        c.append(v)
            yield from _chunks(past, kinds, names, 0)
        yield from _chunks([table.contents, table.ids, table.counts], kinds, names, 0)

    return run


def _bucket(table_bytes: int, seed: int):
    kinds, names = [pa.string(), pa.int64(), pa.int64(), pa.binary()], ["text_sha256", "keep_id", "n", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(table_bytes, seed)
        for batch in batches:
            spill: list[list] = [[], [], [], []]
            for content, keep_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not table.put(content, keep_id, n):
                    for c, v in zip(spill, (None, keep_id, n, content), strict=True):
                        c.append(v)
            yield from _chunks(spill, kinds, names, 3)
        done = [hashlib.sha256(c).hexdigest() for c in table.contents]
        yield from _chunks([done, table.ids, table.counts, [None] * len(done)], kinds, names, 3)

    return run


def content_classes(docs: DataFrame, total_bytes: int, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(text_sha256, keep_id, n): one row for each different content."""
    spark = docs.sparkSession
    small_batches(spark)
    content = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("content")
    records = docs.select("doc_id", content).mapInArrow(_local(table_bytes), LOCAL)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total_bytes // table_bytes))
    done, level = None, 1
    while True:
        dealt = records.repartition(n, F.xxhash64("content", F.lit(level))).mapInArrow(_bucket(table_bytes, level), DEALT)
        dealt = materialize(by_input(dealt, docs), f"grace{level}")
        found = dealt.where("content is null").select("text_sha256", "keep_id", "n")
        done = found if done is None else done.unionByName(found)
        spilled = dealt.where("content is not null").select("content", "keep_id", "n")
        if spilled.isEmpty():
            return done
        records, n, level = spilled, 4 * n, level + 1


def exact_classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce("text", F.lit(""))
    keyed = materialize(by_input(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("bytes")), docs), "keyed")
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    classes = content_classes(docs, total, table_bytes)
    return keyed.join(classes, "text_sha256").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def exact_dedup_stage(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns.

    A row leaves if another row of its class stays; of rows that repeat the staying id the
    first in its partition's order is returned, after a pass over those ids alone."""
    mark, one = unused(docs, "mark"), unused(docs, "id")
    kept = exact_classes(docs).where("kept").select(F.col("doc_id").alias(one), F.col("text_sha256").alias(mark)).distinct()
    same = F.col("l.doc_id").eqNullSafe(F.col(f"r.{one}")) & (F.col(f"l.{mark}") == F.col(f"r.{mark}"))
    stay = docs.withColumn(mark, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("l").join(kept.alias("r"), same, "left_semi")
    return by_input(stay.dropDuplicates(["doc_id", mark]).select(*docs.columns), docs)


OP5_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
