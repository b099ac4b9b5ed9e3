"""LM scoring by a Brown class bigram model: P(w | v) = P(class of w | history of v) * P(w | class of w).

Words are counted over all training documents, by 64-bit fingerprint, and every word has a class.

*Frequent* words are those above a count that at most ``FREQUENT`` words exceed, so that they can be
broadcast.  Their bigrams are counted over all training text into one table of ``PARTS`` parts by word;
exchange clustering sweeps over that table: each word's counts before and after every class tell the
class that raises the likelihood of the class bigrams most.  All words of a sweep are judged by the
same counts, so only a share of them moves; if the likelihood does not rise, half as many do, and the
sweeps end when it rises by less than ``GAIN`` of itself.  ``cluster`` returns it sweep by sweep.

The *other* words are as many as the corpus has; each is counted with the histories before and after it
over all training text, in a table by word, and joins the class that raises the likelihood most, as if
it came new.  As a history they are one class of their own, so a text is scored without a join but for
the counts and classes of its other words.

Smoothing adds 0.1: to class transitions over all classes and the end, and to words within a class; the
class with most words of count 1 has one unseen word more.  The end of a text is a class of its own.

Edge cases: null text is empty and has the end as its one token; a null doc_id counts as empty
text and is held out; rows are scored one by one, so repeated ids do no harm; ties go to the lower
class; an empty table gives no rows, and without training documents every token is unknown; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.store import by_input, materialize, release, small_batches
from turnloom.llm.words import U64, blocks

CLASSES, FREQUENT, PARTS, ADD = 32, 1 << 16, 128, 0.1
GAIN, LEAST_SHARE = 1e-3, 1 / 64
#: Histories beside the classes; the end is a class that only ever follows.
OTHER, END, BEGIN, K = CLASSES, CLASSES + 1, CLASSES + 2, CLASSES + 3
END_WORD = -1  # as a fingerprint


def _documents(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


class _Sums:
    """Counts of integer keys; what is held is merged whenever it has doubled."""

    def __init__(self, kind: type = np.uint64):
        self.keys, self.counts, self.limit, self.kind = [], [], 1 << 20, kind

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys)) > self.limit:
            k, c = self.merged()
            self.keys, self.counts, self.limit = [k], [c], max(1 << 20, 2 * len(k))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their counts."""
        if not self.keys:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        k, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        return k, np.bincount(back, np.concatenate(self.counts), len(k)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a partition, the ends of its texts among them."""
    sums, n_docs = _Sums(), 0
    for batch in batches:
        n_docs += batch.num_rows
        for _, _, block in blocks(batch.column(0)):
            sums.add(block.word_hashes()[0])
    if n_docs:
        k, c = sums.merged()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k.view(np.int64), END_WORD)), pa.array(np.append(c, n_docs))], ["word", "n"])


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, n): every training token with its count, the end among them."""
    return materialize(train.select("text").mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def frequent(vocab: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (sorted) and counts of all words above a count that at most ``most`` exceed."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bars = sorted(((r.s, r.k) for r in vocab.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for s, k in bars:
        if total + k > most:
            break
        least, total = s, total + k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    table = vocab.where(step >= least).select("word", "n").toArrow()
    word, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(word)
    return word[order], n[order].astype(np.float64)


def _places(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each fingerprint among the frequent words; their number for others."""
    if not len(words):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, len(words))


def _before(own: np.ndarray, bounds: np.ndarray, begin: int) -> np.ndarray:
    """What stands before each word of its text."""
    out = np.empty_like(own)
    out[1:], out[:1] = own[:-1], begin
    out[bounds[:-1][np.diff(bounds) > 0]] = begin
    return out


def _last(own: np.ndarray, bounds: np.ndarray, begin: int) -> np.ndarray:
    """What stands before the end of each text."""
    out = np.full(len(bounds) - 1, begin, own.dtype)
    full = np.diff(bounds) > 0
    out[full] = own[bounds[1:][full] - 1]
    return out


# the bigram table: sorted codes in planes of bytes, as most steps between codes are small


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


TABLE = "part int, side int, codes binary, counts binary"


def _parts(keys: np.ndarray, counts: np.ndarray, size: int, side: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted codes ``own * size + other`` by the part of ``own``."""
    part = keys // size % PARTS
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(PARTS + 1))
    for p in range(PARTS):
        at = order[cut[p] : cut[p + 1]]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([side], pa.int32()), pa.array([_pack(np.diff(keys[at], prepend=0))], pa.binary()), pa.array([_pack(counts[at])], pa.binary())], ["part", "side", "codes", "counts"])


def bigrams(train: DataFrame, words: np.ndarray) -> DataFrame:
    """Counts of all bigrams of places, by part: side 0 by the first word, side 1 by the second.

    Places after the frequent words': any other word, the end, the begin."""
    n = len(words)
    size = n + 3
    shared = train.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                h, bounds = block.word_hashes()
                own = _places(shared.value, h)
                sums.add(np.concatenate((_before(own, bounds, n + 2) * size + own, _last(own, bounds, n + 2) * size + n + 1)))
        keys, counts = sums.merged()
        yield from _parts(keys, counts, size, 0)
        back = keys % size * size + keys // size
        order = np.argsort(back[keys % size < n], kind="stable")
        yield from _parts(back[keys % size < n][order], counts[keys % size < n][order], size, 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], _Sums] = {}
        for batch in batches:
            for p, side, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault((p, side), _Sums(np.int64)).add(np.cumsum(_unpack(codes)), _unpack(counts))
        for (p, side), sums in found.items():
            keys, counts = sums.merged()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([side], pa.int32()), pa.array([_pack(np.diff(keys, prepend=0))], pa.binary()), pa.array([_pack(counts)], pa.binary())], ["part", "side", "codes", "counts"])

    table = train.select("text").mapInArrow(run, TABLE).repartition(PARTS, "part").mapInArrow(merge, TABLE)
    return materialize(by_input(table, train), "bigrams")


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, but for what does not depend on classes."""
    return float(_phi(pairs).sum() - _phi(pairs.sum(1)).sum() - _phi(pairs.sum(0)).sum())


def exchange(after: np.ndarray, before: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best class of each word (rows) given its contexts, its class and all class bigrams.

    The gain of a class is the rise of the likelihood with the word taken out of where it is and put
    there.  A word of class ``OTHER`` or none is in no class yet.  Ties go to the lower class."""
    n_after, n_before = after.sum(1), before.sum(1)
    row, col = pairs.sum(1), pairs.sum(0)
    gain = np.zeros((len(own), CLASSES))
    for j in range(CLASSES):
        here = (own == j)[:, None]
        a = np.maximum(pairs[j][None, :] - np.where(here, after, 0), 0)
        b = np.maximum(pairs[:, j][None, :] - np.where(here, before, 0), 0)
        r, c = np.maximum(row[j] - np.where(here[:, 0], n_after, 0), 0), np.maximum(col[j] - np.where(here[:, 0], n_before, 0), 0)
        gain[:, j] = (_phi(a + after) - _phi(a)).sum(1) + (_phi(b + before) - _phi(b)).sum(1) - (_phi(r + n_after) - _phi(r)) - (_phi(c + n_before) - _phi(c))
    return np.where(n_after + n_before > 0, gain.argmax(1), own)


def class_bigrams(table: DataFrame, classes: np.ndarray) -> np.ndarray:
    """K x K counts under the classes of all places."""
    size = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K * K)
        for batch in batches:
            for codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.cumsum(_unpack(codes))
                total += np.bincount(classes[keys // size].astype(np.int64) * K + classes[keys % size], _unpack(counts), K * K)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = table.where("side = 0").select("codes", "counts").mapInArrow(run, "sums binary").collect()
    return sum((np.frombuffer(r.sums) for r in rows), np.zeros(K * K)).reshape(K, K)


def _wished(table: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class each frequent word would move to."""
    size = len(classes)
    n = size - 3

    def contexts(codes: bytes | None, counts: bytes | None, mine: np.ndarray) -> np.ndarray:
        if codes is None:
            return np.zeros((len(mine), K))
        keys, c = np.cumsum(_unpack(codes)), _unpack(counts)
        own, other = keys // size, keys % size
        use = own < n
        return np.bincount(own[use] // PARTS * K + classes[other[use]], c[use], len(mine) * K).reshape(-1, K)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, dict[int, tuple[bytes, bytes]]] = {}
        for batch in batches:
            for p, side, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sides.setdefault(p, {})[side] = (codes, counts)
        for p, both in sides.items():
            mine = np.arange(p, n, PARTS)
            if len(mine):
                after, before = (contexts(*both.get(s, (None, None)), mine) for s in (0, 1))
                best = exchange(after, before, classes[mine].astype(np.int64), pairs)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([best.astype(np.uint8).tobytes()], pa.binary())], ["part", "best"])

    out = classes.copy()
    for r in table.repartition(min(PARTS, max(1, n // 4096)), "part").mapInArrow(run, "part int, best binary").collect():
        out[np.arange(r.part, n, PARTS)] = np.frombuffer(r.best, np.uint8)
    return out


def cluster(table: DataFrame, counts: np.ndarray, most_sweeps: int = 40) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every place, the class bigrams under them, and the likelihood after each sweep.

    Words begin in classes by rank of their counts, in turns."""
    n = len(counts)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(n)
    classes = np.concatenate((rank % CLASSES, [OTHER, END, BEGIN])).astype(np.uint8)
    turn = np.random.default_rng(11).permutation(n) / max(n, 1)
    pairs = class_bigrams(table, classes)
    found, share = [likelihood(pairs)], 0.5
    for sweep in range(most_sweeps) if n else ():
        wished = _wished(table, classes, pairs)
        while True:
            moving = (turn + sweep * 0.5) % 1 < share
            new = classes.copy()
            new[:n][moving] = wished[:n][moving]
            after = class_bigrams(table, new)
            if likelihood(after) > found[-1] or share <= LEAST_SHARE:
                break
            share /= 2
        gain = likelihood(after) - found[-1]
        if gain <= 0:
            break
        classes, pairs = new, after
        found.append(likelihood(after))
        if gain < GAIN * abs(found[-1] - found[0] + gain):
            break
    return classes, pairs, found


def other_classes(train: DataFrame, words: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, class, befores): each other word's class and how often each history stands before it.

    The contexts are counted per word in a table over all training text; a word's are at most
    K * K rows."""
    shared = train.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                h, bounds = block.word_hashes()
                own = classes[_places(shared.value, h)].astype(np.int64)
                after = np.empty_like(own)
                after[:-1], after[-1:] = own[1:], END
                after[bounds[1:][np.diff(bounds) > 0] - 1] = END
                rare = own == OTHER
                code = (_before(own, bounds, BEGIN) * K + after)[rare]
                order = np.lexsort((code, h[rare]))
                hs, code = h[rare][order], code[order]
                new = np.ones(len(hs), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (code[1:] != code[:-1])
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(hs[first].view(np.int64)), pa.array(code[first].astype(np.int16)), pa.array(np.diff(np.append(first, len(hs))).astype(np.int32))], ["word", "code", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            items = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            code, n = items.field("code").to_numpy().astype(np.int64), items.field("n").to_numpy()
            before = np.bincount(row * K + code // K, n, batch.num_rows * K).reshape(-1, K)
            after = np.bincount(row * K + code % K, n, batch.num_rows * K).reshape(-1, K)
            mine = exchange(after, before, np.full(batch.num_rows, OTHER), pairs)
            where, history = np.nonzero(before)
            befores = pa.StructArray.from_arrays([pa.array(history.astype(np.int8)), pa.array(before[where, history].astype(np.int64))], ["h", "n"])
            cut = np.searchsorted(where, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine.astype(np.int8)), pa.ListArray.from_arrays(pa.array(cut), befores)], ["word", "class", "befores"])

    rows = train.select("text").mapInArrow(run, "word bigint, code smallint, n int")
    per = rows.repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("contexts"))
    return materialize(per.mapInArrow(best, "word bigint, class tinyint, befores array<struct<h:tinyint,n:bigint>>"), "others")


class Model:
    """Counts and classes of a training corpus, with the logarithms that scores are sums of."""

    def __init__(self, train: DataFrame, most: int = FREQUENT):
        self.vocab = vocabulary(train)
        self.tokens, self.types = (int(x) for x in self.vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
        self.ends = float(self.vocab.where(F.col("word") == END_WORD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        self.words, self.counts = frequent(self.vocab.where(F.col("word") != END_WORD), most)
        table = bigrams(train, self.words)
        self.classes, pairs, self.history = cluster(table, self.counts)
        release(table)
        others = other_classes(train, self.words, self.classes, pairs)
        self.known = materialize(others.join(self.vocab, "word").select("word", "n", "class"), "known")
        moves = pairs.copy()
        moves[:, OTHER] = 0  # those words are in classes now
        for r in others.select("class", F.explode("befores").alias("b")).groupBy("class", "b.h").agg(F.sum("b.n").alias("n")).collect():
            moves[r.h, r["class"]] += r.n
        size, kinds, once = np.zeros(K), np.zeros(K), np.zeros(K)
        own = self.classes[: len(self.words)].astype(np.int64)
        size += np.bincount(own, self.counts, K)
        kinds += np.bincount(own, minlength=K)
        for r in self.known.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("o")).collect():
            size[r["class"]] += r.n
            kinds[r["class"]] += r.v
            once[r["class"]] += r.o
        release(others)
        self.unseen = int(once[:CLASSES].argmax())
        kinds[self.unseen] += 1
        to = [*range(CLASSES), END]
        step = np.full((K, K), -np.inf)
        step[:, to] = np.log10((moves[:, to] + ADD) / (moves[:, to].sum(1, keepdims=True) + ADD * len(to)))
        self.step = step
        self.spread = np.log10(size + ADD * np.maximum(kinds, 1))

    def close(self) -> None:
        release(self.vocab, self.known)


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, local double, others array<struct<word:bigint,h:int,tf:bigint>>"


def _scores(model: Model, spark: SparkSession):
    """Per document: what is known here, and the other words with their histories and counts."""
    words, counts = (spark.sparkContext.broadcast(x) for x in (model.words, model.counts))
    classes, step, spread, ends = model.classes.astype(np.int64), model.step, model.spread, model.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        n_words, end_log = len(words.value), np.log10(ends + ADD)
        logs_of = np.append(np.log10(counts.value + ADD), 0.0)
        for batch in batches:
            for i, j, block in blocks(batch.column(2)):
                h, bounds = block.word_hashes()
                n = np.diff(bounds)
                at = _places(words.value, h)
                here = at < n_words
                own = classes[at]
                before = _before(own, bounds, BEGIN)
                total = lambda x, b=bounds: np.diff(np.concatenate(([0.0], np.cumsum(x)))[b])
                local = total(np.where(here, np.where(here, step[before, np.where(here, own, 0)], 0.0) + logs_of[at] - spread[own], 0.0)) + step[_last(own, bounds, BEGIN), END]
                word, tf, history, per = _others(np.repeat(np.arange(block.n), n)[~here], h[~here], before[~here], block.n)
                items = pa.StructArray.from_arrays([pa.array(word.view(np.int64)), pa.array(history.astype(np.int32)), pa.array(tf)], ["word", "h", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + block.n)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n + 1),
                        pa.array(np.round(total(here)).astype(np.int64) + int(ends > 0)), pa.array(total(logs_of[at] * here) + end_log), pa.array(local), pa.ListArray.from_arrays(pa.array(per), items),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "local", "others"],
                )
                row += block.n

    return run


def _others(doc: np.ndarray, h: np.ndarray, history: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and histories of each document with their counts, and the documents' bounds among them."""
    order = np.lexsort((history, h, doc))
    doc, h, history = doc[order], h[order], history[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (history[1:] != history[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), history[first], np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)


def _looked_up(values: np.ndarray, at: Column) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in values.reshape(-1)]), at)


def score_documents(docs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    small_batches(docs.sparkSession)
    every = _documents(docs)
    model = Model(every.where(~F.col("held_out")).select("text"), most)
    base = float(np.log10(model.tokens + ADD * (model.types + 1)))
    rows = materialize(every.mapInArrow(_scores(model, docs.sparkSession), SCORED), "scored")
    found = rows.select("row", F.explode("others").alias("o")).select("row", "o.*").join(model.known, "word", "left")
    n, tf = F.coalesce("n", F.lit(0)), F.col("tf")
    own = F.coalesce(F.col("class").cast("int"), F.lit(model.unseen))
    log = F.log10(n + ADD)
    term = _looked_up(model.step[:, :CLASSES], F.col("h") * CLASSES + own) + log - _looked_up(model.spread[:CLASSES], own)
    looked = found.groupBy("row").agg(F.sum(tf * log).alias("more"), F.sum(F.when(n > 0, tf).otherwise(0)).alias("also"), F.sum(tf * term).alias("terms"))
    zero = F.lit(0.0)
    logs = F.col("logs") + F.coalesce("more", zero)
    return rows.join(looked, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("local") + F.coalesce("terms", zero)).alias("score"),
    )


def op4_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
