"""Quality rules: counts over whole texts, and line labels by a linear-chain CRF.

The counts reject texts of fewer than 20 words and texts in which more than 30 % of the words lie
in 8-word windows found twice or more.  Of the others, each line with a word is an item of a
sequence.  Its features are binned shares of its characters and words (symbols, capitals, words
that end in symbols, cell marks, repeats of its commonest word, length, and whether the line was
there before); a CRF with two labels, content and boilerplate, is decoded by Viterbi, and a text
is kept if content lines hold at least ``SHARE`` of its words.

The CRF is fitted by gradient ascent on at most ``MOST_LABELS`` labelled rows, those of smallest
md5 of their id.  That bound is the one sample here.  The rows' labels are of whole documents, so the
lines' labels are found in rounds: first by a line's own features, told apart over all lines by their
documents' quality, then by the decoded chain; after each round the lines of least margin change
sides until every document's content share agrees with its quality.  A junk document may thus have
content lines and a good one boilerplate, and the chain sees labels change in both directions.

Edge cases: null text has no words and fails; a text with no labelled line cannot pass the counts;
repeated rows repeat their result; without labels of both kinds the CRF calls every line content;
labels of null quality or without a document are not used; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.store import by_input, small_batches
from turnloom.llm.words import SPACE, U64, Block, blocks, mix, windows

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
SHARE, MOST_LABELS, ROUNDS = 0.5, 2000, 3
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = True
MARK = SYMBOL.copy()
MARK[ord("!")] = True
BINS = np.array([0.02, 0.1, 0.25, 0.5, 0.8])
LENGTHS = np.array([4, 10, 25, 60, 150])
SHARES = 5
FEATURES = SHARES * (len(BINS) + 1) + len(LENGTHS) + 1 + 2 + 1  # binned shares, length, seen before, bias
RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"


class Lines:
    """Lines with a word of all texts of a block, and the counts that the rules need."""

    def __init__(self, block: Block):
        data = block.data
        starts, ends, bounds = block.words()
        self.n_words = np.diff(bounds)
        n = block.n
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[block.bounds])
        whole = (data & 0xC0) != 0x80  # bytes that begin a code point
        self.word_chars = sums(~SPACE[data] & whole)
        self.n_symbols = sums(SYMBOL[data])
        hashes = block.fingerprints(data, starts, ends)
        self.n_repeat_words = self._repeats(hashes, bounds, n)
        # lines: text bounds and newlines cut the data
        cuts = np.unique(np.concatenate((block.bounds, np.flatnonzero(data == 10) + 1)))
        line_of = np.searchsorted(cuts, starts, "right") - 1  # of each word
        used, first, self.words = np.unique(line_of, return_index=True, return_counts=True) if len(starts) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
        begin = cuts[used]
        stop = cuts[used + 1] if len(used) else begin
        stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(used) else stop
        self.doc = np.searchsorted(block.bounds, begin, "right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))
        keys = self._salted(block.fingerprints(data, begin, stop), self.doc)
        _, where, back = np.unique(keys, return_index=True, return_inverse=True)
        self.seen = where[back] != np.arange(len(keys))
        self.n_dup_lines = np.bincount(self.doc, self.seen, n).astype(np.int64)
        over = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        total = lambda flags: (c := np.concatenate(([0], np.cumsum(flags))))[stop] - c[begin]
        letters = np.maximum(total(LETTER[data]), 1)
        marked = over(MARK[data[ends - 1]].astype(float)) if len(starts) else np.zeros(0)
        cells = over(((ends - starts == 1) & (data[starts] == ord("|"))).astype(float)) if len(starts) else np.zeros(0)
        same = self._commonest(hashes, line_of, used)
        chars = np.maximum(stop - begin, 1)
        self.shares = np.stack([total(SYMBOL[data]) / chars, total(UPPER[data]) / letters, marked / self.words, cells / self.words, np.where(self.words > 5, same / np.maximum(self.words, 1), 0)], 1) if len(used) else np.zeros((0, SHARES))

    @staticmethod
    def _salted(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(keys + mix(doc.astype(np.uint64) + U64(1)))

    def _repeats(self, hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
        grams, at = windows(hashes, bounds, WINDOW)
        if not len(grams):
            return np.zeros(n, np.int64)
        doc = np.repeat(np.arange(n), np.diff(at))
        _, back, count = np.unique(self._salted(grams, doc), return_inverse=True, return_counts=True)
        twice = count[back] > 1
        first = (np.arange(len(grams)) - at[doc] + bounds[doc])[twice]
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + WINDOW, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(step)[:-1] > 0)))
        return np.diff(covered[bounds])

    def _commonest(self, hashes: np.ndarray, line_of: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Words that equal the line's most frequent word."""
        if not len(used):
            return np.zeros(0)
        keys, first, count = np.unique(self._salted(hashes, line_of), return_index=True, return_counts=True)
        out = np.zeros(len(used))
        np.maximum.at(out, np.searchsorted(used, line_of[first]), count)
        return out

    def features(self) -> np.ndarray:
        """Indices of each line's active features, one per group."""
        width = len(BINS) + 1
        groups = [np.searchsorted(BINS, self.shares[:, k], "right") + k * width for k in range(SHARES)]
        at = SHARES * width
        groups.append(np.searchsorted(LENGTHS, self.words, "right") + at)
        at += len(LENGTHS) + 1
        groups.append(self.seen.astype(int) + at)
        groups.append(np.full(len(self.words), at + 2))
        return np.stack(groups, 1)


class LineCrf:
    """Two labels: 0 content, 1 boilerplate."""

    def __init__(self, state: np.ndarray | None = None, move: np.ndarray | None = None):
        self.state = np.zeros((FEATURES, 2)) if state is None else state
        self.move = np.zeros((2, 2)) if move is None else move

    @staticmethod
    def _steps(bounds: np.ndarray):
        """Sequences aligned at their start: for each position, the lines there, longest first."""
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        for t in range(int(n.max(initial=0))):
            live = order[: int(np.searchsorted(-n[order], -t, "left"))]
            yield bounds[live] + t, live

    def viterbi(self, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Most likely labels of all sequences at once; ties go to content."""
        score = self.state[feats].sum(1)
        back = np.zeros((len(score), 2), np.int8)
        steps = list(self._steps(bounds))
        best = score.copy()
        for at, _ in steps[1:]:
            arrive = best[at - 1][:, :, None] + self.move[None]
            back[at] = arrive.argmax(1)
            best[at] = score[at] + arrive.max(1)
        out = np.zeros(len(score), np.int8)
        last = bounds[1:][np.diff(bounds) > 0] - 1
        out[last] = best[last].argmax(1)
        ends = np.zeros(len(score), bool)
        ends[last] = True
        for at, _ in reversed(steps[1:]):
            out[at - 1] = np.where(ends[at - 1], out[at - 1], back[at, out[at]])
        return out

    def _sums(self, score: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the forward and backward sums of all lines."""
        alpha, beta = score.copy(), np.zeros_like(score)
        for at, _ in steps[1:]:
            alpha[at] = score[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + self.move, axis=1)
        for at, _ in reversed(steps[1:]):
            beta[at - 1] = np.logaddexp.reduce(self.move[None] + (score[at] + beta[at])[:, None, :], axis=2)
        return alpha, beta

    def margins(self, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-odds of boilerplate of every line."""
        alpha, beta = self._sums(self.state[feats].sum(1), list(self._steps(bounds)))
        return (alpha + beta) @ np.array([-1.0, 1.0])

    def fit(self, feats: np.ndarray, bounds: np.ndarray, gold: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> LineCrf:
        """Full-batch ascent (Adam) on the mean log-likelihood, by forward and backward sums."""
        steps = list(self._steps(bounds))
        n = max(len(gold), 1)
        params = [self.state, self.move]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        ends = np.zeros(len(gold), bool)
        ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
        for r in range(1, rounds + 1):
            score = self.state[feats].sum(1)
            alpha, beta = self._sums(score, steps)
            node = alpha + beta
            node = np.exp(node - np.logaddexp.reduce(node, axis=1)[:, None])
            grads = [np.zeros_like(p) for p in params]
            push = np.eye(2)[gold] - node
            for k in range(feats.shape[1]):
                np.add.at(grads[0], feats[:, k], push)
            if len(steps) > 1:
                at = np.flatnonzero(~ends)
                edge = alpha[at][:, :, None] + self.move + (score[at + 1] + beta[at + 1])[:, None, :]
                edge = np.exp(edge - np.logaddexp.reduce(edge.reshape(len(at), 4), axis=1)[:, None, None])
                np.add.at(grads[1], (gold[at], gold[at + 1]), 1.0)
                grads[1] -= edge.sum(0)
            for i, p in enumerate(params):
                g = grads[i] / n - ridge * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p += 0.2 * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.99**r)) + 1e-8)
        return self


def agreed(label: np.ndarray, margin: np.ndarray, words: np.ndarray, bounds: np.ndarray, junk: np.ndarray) -> np.ndarray:
    """Line labels changed where they must: content has ``SHARE`` of a good document's words and less of a junk one's.

    The lines closest to the other side change first, earlier ones of equal margin before later ones."""
    out = label.copy()
    for k, bad in enumerate(junk):
        at = np.arange(bounds[k], bounds[k + 1])
        total = words[at].sum()
        for i in at[np.argsort(np.abs(margin[at]), kind="stable")]:
            content = words[at][out[at] == 0].sum()
            if (content < SHARE * total) == bad:
                break
            if out[i] == (0 if bad else 1):
                out[i] = 1 if bad else 0
    return out


def learn(feats: np.ndarray, words: np.ndarray, bounds: np.ndarray, junk: np.ndarray, rounds: int = ROUNDS) -> LineCrf:
    """The CRF of documents that are junk or not, with line labels found in rounds."""
    of_doc = np.repeat(junk.astype(int), np.diff(bounds))
    alone = np.arange(len(feats) + 1)
    crf, at = LineCrf().fit(feats, alone, of_doc), alone
    for _ in range(rounds):
        gold = agreed(crf.viterbi(feats, at), crf.margins(feats, at), words, bounds, junk)
        crf, at = LineCrf().fit(feats, bounds, gold), bounds
    return crf


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> LineCrf:
    """Fit on at most ``most`` labelled documents; the rows that reach the driver are bounded by it."""
    small_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    picked = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(chosen), F.col("d") == F.col("doc_id")).select("quality", "text")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, block in blocks(b.column(1)):
                lines = Lines(block)
                rows = np.concatenate((lines.features(), lines.words[:, None]), 1).astype(np.int32)
                parts = [rows[lines.bounds[k] : lines.bounds[k + 1]].tobytes() for k in range(block.n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(parts, pa.binary())], ["quality", "items"])

    got = sorted((bytes(r["items"]), r.quality) for r in picked.mapInArrow(items, "quality int, items binary").collect() if r["items"])
    if len({q == 0 for _, q in got}) < 2:
        return LineCrf()
    seqs = [np.frombuffer(f, np.int32).reshape(-1, SHARES + 4).astype(np.int64) for f, _ in got]
    rows = np.concatenate(seqs)
    return learn(rows[:, :-1], rows[:, -1], np.concatenate(([0], np.cumsum([len(s) for s in seqs]))), np.array([q == 0 for _, q in got]))


def judge(docs: DataFrame, crf: LineCrf, carry: Column | None = None) -> DataFrame:
    """Counts and verdict of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, block in blocks(b.column(1)):
                lines = Lines(block)
                label = crf.viterbi(lines.features(), lines.bounds)
                content = np.bincount(lines.doc, np.where(label == 0, lines.words, 0), block.n)
                share = content / np.maximum(lines.n_words, 1)
                failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT * lines.n_words)
                cols = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(failed), pa.array(~failed & (share >= SHARE)), pa.array(share.astype(float))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents, by a CRF fitted on the labels beside them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("content_share")


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep; decided in the pass that carries the row on."""
    crf = train(docs, labels)
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for i, j, block in blocks(b.column(at)):
                lines = Lines(block)
                label = crf.viterbi(lines.features(), lines.bounds)
                content = np.bincount(lines.doc, np.where(label == 0, lines.words, 0), block.n)
                failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT * lines.n_words)
                yield b.slice(i, j - i).filter(pa.array(~failed & (content / np.maximum(lines.n_words, 1) >= SHARE)))

    return by_input(docs.select(*names).mapInArrow(run, docs.schema), docs)
