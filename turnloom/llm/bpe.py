"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of ``chunk`` characters, each seen with ``overlap`` more.  Each is
pre-tokenised alone, from where it happens to begin; those of a text of many chunks in parallel
threads, ``AHEAD`` chunks at a time.  Two neighbours are stitched at the first position in their
overlap that both see as a pre-token boundary and that follows a character other than white space:
from there on they agree, as a pre-token depends on the characters after its start only.  Where no
such position exists (one pre-token spans the overlap) the left chunk is taken on with twice the
reach.  The pre-tokens of the stitched pieces are then encoded one by one, the common ones from a
table of bounded size, and decoding concatenates the raw bytes of the ids.  What is held is bound by
the chunk and by the longest pre-token, not by the text.

Edge cases: null text is empty and has no ids; ids and text of a row stay with it, so ids that
repeat or are null do no harm; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.store import small_batches

CHUNK, OVERLAP, AHEAD, MOST_KNOWN, LONGEST_KNOWN = 1024, 128, 64, 1 << 17, 64
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_codecs: dict[tuple[str, str], Codec] = {}


class Encoded(NamedTuple):
    """A pre-token's ids, the same as text, and the bytes they decode to."""

    ids: list[int]
    text: str
    decoded: bytes


class Codec:
    """Ranks and pattern of one vocabulary, with what a worker keeps of it."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 2):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.chunk, self.overlap, self.threads = chunk, max(1, overlap), threads
        self.pool: ThreadPoolExecutor | None = None
        self.known: dict[str, Encoded] = {}

    def bounds(self, text: str, start: int, stop: int) -> list[int]:
        """Ends of the pre-tokens seen from ``start``, of those that end before ``stop``.

        The last ones may be cut off or decided by what lies past ``stop``: the pre-token
        that touches it is left out, and so is the one before."""
        ends = [m.end() for m in self.pattern.finditer(text, start, stop, concurrent=True)]
        return ends if stop == len(text) else ends[:-2]

    def _views(self, text: str, spans: list[tuple[int, int]]) -> Iterator[list[int]]:
        """What each chunk sees as boundaries, its own start among them."""
        view = lambda s: [s[0], *self.bounds(text, *s)]
        if len(spans) <= AHEAD or self.threads < 2:
            yield from map(view, spans)
            return
        self.pool = self.pool or ThreadPoolExecutor(self.threads)
        for k in range(0, len(spans), AHEAD):
            yield from self.pool.map(view, spans[k : k + AHEAD])

    def pieces(self, text: str) -> Iterator[list[int]]:
        """The text's pre-token boundaries, from start to end, as stitched pieces that share their joints."""
        n, step = len(text), self.chunk
        spans = [(i, min(n, i + step + self.overlap)) for i in range(0, n, step)]
        views = self._views(text, spans)
        left, at = next(views, [0]), 0
        for k, right in enumerate(views, 1):
            begin, reach = spans[k][0], spans[k - 1][1]
            theirs = set(right)
            while True:
                meet = next((p for p in left if p >= begin and p in theirs and p > at and not text[p - 1].isspace()), None)
                if meet is not None or reach == n or reach > spans[k][1]:
                    break
                reach = min(n, 2 * reach - at)
                left = [at, *self.bounds(text, at, reach)]
            if meet is None:  # the right chunk never falls in with the left: its part is seen from the left
                left = [at, *self.bounds(text, at, min(n, max(reach, spans[k][1])))]
                continue
            yield [p for p in left if p <= meet]
            left, at = [p for p in right if p >= meet], meet
        yield left

    def encode_pretoken(self, text: str) -> Encoded:
        ids = self.encoding._core_bpe.encode_single_piece(text.encode())
        return Encoded(ids, " ".join(map(str, ids)), self.decode(ids))

    def encode_parts(self, text: str) -> Iterator[list[Encoded]]:
        """The encoded pre-tokens of the whole text, piece by piece."""
        for piece in self.pieces(text):
            out = []
            for a, b in itertools.pairwise(piece):
                part = text[a:b]
                found = self.known.get(part)
                if found is None:
                    found = self.encode_pretoken(part)
                    if len(part) <= LONGEST_KNOWN:
                        if len(self.known) >= MOST_KNOWN:
                            self.known.clear()
                        self.known[part] = found
                out.append(found)
            yield out

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_parts(text) for x in part for i in x.ids]

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes of the ids, concatenated."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def encode_ids(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""
    small_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t) for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids); a null array is empty."""
    small_batches(encoded.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, content binary")


def token_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Digests of ids and of their decoded bytes, in one pass without keeping either whole."""
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            rows: list[list] = [[], [], []]
            for text in _texts(b.column(1)):
                n, ids_hash, out_hash = 0, hashlib.sha256(), hashlib.sha256()
                for part in c.encode_parts(text):
                    if part:
                        ids_hash.update(((" " if n else "") + " ".join([x.text for x in part])).encode())
                        out_hash.update(b"".join([x.decoded for x in part]))
                        n += sum([len(x.ids) for x in part])
                for r, v in zip(rows, (n, ids_hash.hexdigest(), out_hash.hexdigest()), strict=True):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the 50k byte-level ranks and decoded again."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def bpe_stage(docs: DataFrame) -> DataFrame:
    """The same for the documents a pipeline kept."""
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
