"""Linear-chain models over long-form scores: state (seq, t, label, s), transition matrices on the driver side.

A sequence becomes one row, its scores in order of the items; dynamic programs run over Arrow batches of
such rows in numpy, all sequences of a batch step by step at once.  Transitions, bounded by the labels,
travel with the function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def features(items: DataFrame, least: float = 0.0) -> DataFrame:
    """(kind, src, dst, freq) counts of state, transition, begin and end features, of those with ``least`` or more.

    ``items``: seq, t, label, attrs.  Every label has its begin and end feature."""
    w = Window.partitionBy("seq").orderBy("t")
    at = items.select("seq", "t", "label", "attrs", F.lag("label").over(w).alias("prev"), F.lead("label").over(w).alias("next"))
    one = F.lit(1.0)
    parts = [
        at.select(F.lit("state").alias("kind"), F.explode("attrs").alias("src"), F.col("label").alias("dst"), one.alias("freq")),
        at.select(F.when(F.col("prev").isNull(), "begin").otherwise("trans").alias("kind"), F.coalesce("prev", F.lit("")).alias("src"), F.col("label").alias("dst"), one.alias("freq")),
        at.where("next is null").select(F.lit("end").alias("kind"), F.col("label").alias("src"), F.lit("").alias("dst"), one.alias("freq")),
        items.select("label").distinct().select(F.explode(F.array(F.struct(F.lit("begin").alias("kind"), F.lit("").alias("src"), F.col("label").alias("dst")), F.struct(F.lit("end").alias("kind"), F.col("label").alias("src"), F.lit("").alias("dst")))).alias("x")).select("x.*", F.lit(0.0).alias("freq")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "src", "dst").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)


def state_scores(items: DataFrame, weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(seq, t, label, s) for every label, 0 where no attribute is known."""
    hits = items.select("seq", "t", F.explode("attrs").alias("f")).join(weights, "f").groupBy("seq", "t", "label").agg(F.sum("w").alias("s"))
    grid = items.select("seq", "t").crossJoin(F.broadcast(labels))  # as many as labels
    return grid.join(hits, ["seq", "t", "label"], "left").select("seq", "t", "label", F.coalesce("s", F.lit(0.0)).alias("s"))


class Lattice:
    """Dynamic programs on one sequence: scores (items x labels), moves, begins and ends."""

    def __init__(self, moves: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.moves, self.begin, self.end = moves, begin, end

    def viterbi(self, s: np.ndarray) -> tuple[list[int], float]:
        best, back = s[0] + self.begin, []
        for row in s[1:]:
            arrive = best[:, None] + self.moves
            back.append(arrive.argmax(0))
            best = row + arrive.max(0)
        best = best + self.end
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1], float(best.max())

    def forward(self, s: np.ndarray) -> np.ndarray:
        out = [s[0] + self.begin]
        for row in s[1:]:
            out.append(row + np.logaddexp.reduce(out[-1][:, None] + self.moves, axis=0))
        return np.stack(out)

    def backward(self, s: np.ndarray) -> np.ndarray:
        out = [self.end]
        for row in s[:0:-1]:
            out.append(np.logaddexp.reduce(self.moves + (row + out[-1])[None, :], axis=1))
        return np.stack(out[::-1])

    def log_norm(self, s: np.ndarray) -> float:
        return float(np.logaddexp.reduce(self.forward(s)[-1] + self.end))

    def marginals(self, s: np.ndarray) -> np.ndarray:
        return np.exp(self.forward(s) + self.backward(s) - self.log_norm(s))

    def path_score(self, s: np.ndarray, path) -> float:
        return float(self.begin[path[0]] + self.end[path[-1]] + s[np.arange(len(path)), path].sum() + sum(self.moves[a, b] for a, b in zip(path, path[1:], strict=False)))


class Batch:
    """Sequences of one Arrow batch: scores of all items, the sequences' bounds, and the items by step."""

    def __init__(self, scores: np.ndarray, bounds: np.ndarray):
        self.s, self.bounds = scores, bounds
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        #: For each step the items there, longest sequences first.
        self.steps = [bounds[order[: int(np.searchsorted(-n[order], -t, "left"))]] + t for t in range(int(n.max(initial=0)))]
        self.last = bounds[1:] - 1
        self.ends = np.zeros(len(scores), bool)
        self.ends[self.last] = True

    def viterbi(self, lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all items and the score of each sequence's path; ties go to the lower label."""
        best, back = self.s.copy(), np.zeros(self.s.shape, np.int64)
        best[self.bounds[:-1]] += lat.begin
        for at in self.steps[1:]:
            arrive = best[at - 1][:, :, None] + lat.moves[None]
            back[at] = arrive.argmax(1)
            best[at] = self.s[at] + arrive.max(1)
        final = best[self.last] + lat.end
        out = np.zeros(len(self.s), np.int64)
        out[self.last] = final.argmax(1)
        for at in reversed(self.steps[1:]):
            before = at - 1
            out[before] = np.where(self.ends[before], out[before], back[at, out[at]])
        return out, final.max(1)

    def forward(self, lat: Lattice) -> np.ndarray:
        out = self.s.copy()
        out[self.bounds[:-1]] += lat.begin
        for at in self.steps[1:]:
            out[at] = self.s[at] + np.logaddexp.reduce(out[at - 1][:, :, None] + lat.moves[None], axis=1)
        return out

    def backward(self, lat: Lattice) -> np.ndarray:
        out = np.zeros_like(self.s)
        out[self.last] = lat.end
        for at in reversed(self.steps[1:]):
            out[at - 1] = np.logaddexp.reduce(lat.moves[None] + (self.s[at] + out[at])[:, None, :], axis=2)
        return out

    def log_norms(self, lat: Lattice, forward: np.ndarray | None = None) -> np.ndarray:
        fw = self.forward(lat) if forward is None else forward
        return np.logaddexp.reduce(fw[self.last] + lat.end, axis=1)

    def marginals(self, lat: Lattice) -> np.ndarray:
        fw = self.forward(lat)
        return np.exp(fw + self.backward(lat) - np.repeat(self.log_norms(lat, fw), np.diff(self.bounds))[:, None])


    def pair_marginals(self, lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Items that have a successor, and the probabilities of their and its labels."""
        fw, bw = self.forward(lat), self.backward(lat)
        z = np.repeat(self.log_norms(lat, fw), np.diff(self.bounds))
        at = np.flatnonzero(~self.ends)
        return at, np.exp(fw[at][:, :, None] + lat.moves + (self.s[at + 1] + bw[at + 1])[:, None, :] - z[at][:, None, None])


def lined_up(states: DataFrame, labels: list[str]) -> DataFrame:
    """(seq, t array, s array): the items of a sequence in order, their scores by label one after another."""
    item = states.groupBy("seq", "t").agg(*[F.max(F.when(F.col("label") == x, F.col("s"))).alias(f"s{k}") for k, x in enumerate(labels)])
    rows = item.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("t", F.array(*[f"s{k}" for k in range(len(labels))]).alias("s")))).alias("x"))
    return rows.select("seq", F.col("x.t").alias("t"), F.flatten(F.col("x.s")).alias("s"))


def _batched(states: DataFrame, labels: list[str], schema: str, body) -> DataFrame:
    """``body`` gets a Batch and the arrays of the batch's rows: sequence of each row, and t of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t, s = b.column(1), b.column(2)
                bounds = (t.offsets.to_numpy() - t.offsets[0].as_py()).astype(np.int64)
                yield body(Batch(s.flatten().to_numpy().reshape(-1, len(labels)), bounds), b.column(0), t.flatten())

    return lined_up(states, labels).mapInArrow(run, schema)


def _per_item(b: Batch, seq: pa.Array) -> pa.Array:
    return seq.take(pa.array(np.repeat(np.arange(len(b.bounds) - 1), np.diff(b.bounds))))


def decode(states: DataFrame, labels: list[str], lattice: Lattice) -> DataFrame:
    """(seq, t, ans, score): best labels and the path's score."""

    def body(b: Batch, seq: pa.Array, t: pa.Array) -> pa.RecordBatch:
        path, score = b.viterbi(lattice)
        return pa.RecordBatch.from_arrays([_per_item(b, seq), t, pa.array(labels).take(pa.array(path)), pa.array(np.repeat(score, np.diff(b.bounds)))], ["seq", "t", "ans", "score"])

    return _batched(states, labels, "seq string, t bigint, ans string, score double", body)


def log_norms(states: DataFrame, labels: list[str], lattice: Lattice) -> DataFrame:
    return _batched(states, labels, "seq string, log_norm double", lambda b, seq, t: pa.RecordBatch.from_arrays([seq, pa.array(b.log_norms(lattice))], ["seq", "log_norm"]))


def posteriors(states: DataFrame, labels: list[str], lattice: Lattice) -> DataFrame:
    """(seq, t, label, p): marginal probabilities of single labels."""

    def body(b: Batch, seq: pa.Array, t: pa.Array) -> pa.RecordBatch:
        k, n = len(labels), len(b.s)
        each = pa.array(np.repeat(np.arange(n), k))
        return pa.RecordBatch.from_arrays([_per_item(b, seq).take(each), t.take(each), pa.array(labels).take(pa.array(np.tile(np.arange(k), n))), pa.array(b.marginals(lattice).reshape(-1))], ["seq", "t", "label", "p"])

    return _batched(states, labels, "seq string, t bigint, label string, p double", body)


def gradient(items: DataFrame, states: DataFrame, labels: list[str], lattice: Lattice) -> DataFrame:
    """(kind, src, dst, g): expected less observed counts of state, transition, begin and end features."""
    k = len(labels)

    def moves(b: Batch, seq: pa.Array, t: pa.Array) -> pa.RecordBatch:
        _, p = b.pair_marginals(lattice)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(labels, k)), pa.array(np.tile(labels, k)), pa.array(p.sum(0).reshape(-1))], ["src", "dst", "p"])

    post = posteriors(states, labels, lattice)
    gold = items.select("seq", "t", F.col("label").alias("gold"), "attrs")
    w = Window.partitionBy("seq").orderBy("t")
    gold = gold.withColumn("first", F.lag("gold").over(w).isNull()).withColumn("last", F.lead("gold").over(w).isNull())
    d = post.join(gold, ["seq", "t"]).withColumn("g", F.col("p") - F.when(F.col("label") == F.col("gold"), 1.0).otherwise(0.0))
    kind = lambda name, src, dst: [F.lit(name).alias("kind"), src.alias("src"), dst.alias("dst"), F.col("g")]
    state = d.select(*kind("state", F.explode("attrs"), F.col("label")))
    begin = d.where("first").select(*kind("begin", F.lit(""), F.col("label")))
    end = d.where("last").select(*kind("end", F.col("label"), F.lit("")))
    pairs = _batched(states, labels, "src string, dst string, p double", moves).select(*kind("trans", F.col("src"), F.col("dst"))[:3], F.col("p").alias("g"))
    seen = items.select(F.lag("label").over(w).alias("src"), F.col("label").alias("dst")).where("src is not null").select(*kind("trans", F.col("src"), F.col("dst"))[:3], F.lit(-1.0).alias("g"))
    out = state.unionByName(begin).unionByName(end).unionByName(pairs).unionByName(seen)
    return out.groupBy("kind", "src", "dst").agg(F.sum("g").alias("g"))
