"""Learners.  Losses and gradients are partial sums over partitions, added up in two steps; only
the model, whose size is the features' times the labels', lives on the driver.  Fits pack their rows
once into blocks and pass over those.

Order-dependent learners (perceptrons, passive-aggressive, stochastic gradient) train on each shard
in a seeded order and mix the shards' weights after every pass; with one shard they are the
sequential algorithms.  There is a shard for every ``SHARD_ROWS`` rows, chosen by a hash of the row's id,
so that no task has more than about that many."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.blocks import Blocks, Sparse, cores_of, fitted, joined, lent, sparse
from turnloom.operators.chain import Batch, Lattice
from turnloom.operators.optimise import add, conjugate_gradient, lbfgs


SHARD_ROWS = 1 << 14


def summed(rows: DataFrame, partial: Callable[[pd.DataFrame, np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, fan: int = 16) -> tuple[float, np.ndarray]:
    """Loss and gradient at ``w`` over all rows.

    ``w`` travels as a broadcast, freed afterwards.  Each partition gives one vector; ``fan``
    tasks add them up before the driver adds ``fan`` vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def one(batches):
        loss, g, some = 0.0, np.zeros(len(shared.value)), False
        for b in batches:
            if len(b):
                some = True
                x, y = partial(b, shared.value)
                loss += x
                g += y
        if some:
            yield pd.DataFrame({"loss": [loss], "g": [g.tobytes()]})

    def add(batches):
        loss, g = 0.0, np.zeros(len(w_size))
        for b in batches:
            loss += b["loss"].sum()
            for x in b["g"]:
                g += np.frombuffer(x)
        yield pd.DataFrame({"loss": [loss], "g": [g.tobytes()]})

    w_size = range(len(w))
    parts = rows.mapInPandas(one, "loss double, g binary")
    n = getattr(rows, "_n_parts", None) or rows.rdd.getNumPartitions()
    rows._n_parts = n
    if n > fan:
        parts = parts.repartition(fan).mapInPandas(add, "loss double, g binary")
    loss, g = 0.0, np.zeros(len(w))
    for r in parts.collect():  # at most fan vectors
        loss += r.loss
        g += np.frombuffer(r.g)
    shared.unpersist()
    return loss, g


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = b["ids"].map(len).to_numpy()
    ids = np.concatenate(b["ids"].to_list()).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
    return ids, np.repeat(np.arange(len(b)), n), b["label"].to_numpy().astype(np.int64)


def _softmax(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = s.max(1, keepdims=True)
    z = np.log(np.exp(s - top).sum(1, keepdims=True)) + top
    return np.exp(s - z), z[:, 0]


def _scores(ids: np.ndarray, row: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    out = np.zeros((n, m.shape[1]))
    np.add.at(out, row, m[ids])
    return out


def labelled(b: pd.DataFrame) -> tuple[Sparse, np.ndarray]:
    """A block of rows with their labels."""
    return sparse(b["ids"]), b["label"].to_numpy().astype(np.int64)


def of_frame(pack: Callable, core: Callable):
    """``core`` on rows that are not packed: loss and gradient."""

    def run(b: pd.DataFrame, w: np.ndarray):
        g = np.zeros(len(w))
        return core(pack(b), w, g), g

    return run


def maxent_core(classes: int):
    def run(block, w: np.ndarray, g: np.ndarray) -> float:
        x, y = block
        s = x.scores(w.reshape(-1, classes))
        p, z = _softmax(s)
        at = np.arange(x.n)
        p[at, y] -= 1
        x.push(p, g.reshape(-1, classes))
        return float((z - s[at, y]).sum())

    return run


def maxent_partial(classes: int):
    return of_frame(labelled, maxent_core(classes))


def maxent_hits(classes: int):
    """Right answers of a block, and its rows; the first of the highest scores is the answer."""

    def run(block, w: np.ndarray) -> tuple[float, float]:
        x, y = block
        return float((x.scores(w.reshape(-1, classes)).argmax(1) == y).sum()), float(x.n)

    return run


class MaxEnt:
    """Multinomial logistic regression; the ridge includes the bias, weights begin at 0."""

    def __init__(self, classes: int, features: int):
        self.classes, self.features = classes, features
        self.w = np.zeros(classes * features)

    @staticmethod
    def packed(rows: DataFrame) -> Blocks:
        """Blocks of rows for several fits."""
        return Blocks(rows.select("label", "ids"), labelled)

    def fit(self, rows: DataFrame | Blocks, ridge: float, dev: DataFrame | Blocks | None = None, most: int = 150, l1: float = 0.0) -> MaxEnt:
        """Keeps the weights of the strictly best dev accuracy, if there is dev data."""
        classes, start = self.classes, self.w

        def run(own, held):
            best = [-1.0, start.copy()]

            def f(w):
                loss, g = own.summed(maxent_core(classes), w)
                return loss + ridge / 2 * float(w @ w), add(g, ridge, w)

            def watch(w, _):
                acc = held.counted(maxent_hits(classes), w)
                if acc > best[0]:
                    best[:] = [acc, w.copy()]

            w, _ = lbfgs(f, start, most=most, l1=l1, watch=watch if held is not None else None)
            return best[1] if best[0] >= 0 else w

        with lent(rows, labelled) as own, lent(dev, labelled) as held:
            self.w = fitted(run, len(start), own, held)
        return self

    def accuracy(self, rows: DataFrame | Blocks, w: np.ndarray | None = None) -> float:
        with lent(rows, labelled) as own:
            return own.counted(maxent_hits(self.classes), self.w if w is None else w)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(rid, pred, probs): first of the highest."""
        m = self.w.reshape(-1, self.classes)

        def run(batches):
            for b in batches:
                ids, row, _ = _flat(b)
                p, _ = _softmax(_scores(ids, row, len(b), m))
                yield pd.DataFrame({"rid": b["rid"], "pred": p.argmax(1), "probs": list(p)})

        return rows.select("rid", "label", "ids").mapInPandas(run, "rid bigint, pred int, probs array<double>")

    def table(self, spark) -> DataFrame:
        m = self.w.reshape(-1, self.classes)
        return spark.createDataFrame(pd.DataFrame({"id": np.repeat(np.arange(len(m)), self.classes), "c": np.tile(np.arange(self.classes), len(m)), "w": m.reshape(-1)}))


class Suite:
    """Multiclass models of all layouts: rows of (rid, ids, vals, costs, weight).

    *Implicit* rows have one list of features, with weights for every class; *explicit* ones a list for
    each class, with weights in common.  ``vals`` are the features' values.  ``costs`` has an entry for
    each class, of a single label 0 for it and 1 for the others: a class counts by what it saves
    against the dearest one, and classes of infinite cost are left out.  ``weight`` counts the row."""

    def __init__(self, classes: int, features: int, explicit: bool = False):
        self.classes, self.features, self.explicit = classes, features, explicit
        self.w = np.zeros(features if explicit else features * classes)

    def pack(self, b: pd.DataFrame):
        """The lists of features, one a row or one a row and class, with costs and weights."""
        flat = (lambda x: [y for xs in x for y in xs]) if self.explicit else list
        return sparse(flat(b["ids"]), flat(b["vals"]), self.explicit), np.stack(b["costs"].to_numpy()).astype(float), b["weight"].to_numpy().astype(float)

    def packed(self, rows: DataFrame) -> Blocks:
        """Blocks of rows for several fits."""
        return Blocks(rows.select("ids", "vals", "costs", "weight"), self.pack)

    @property
    def width(self) -> int:
        """Weights of a feature."""
        return 1 if self.explicit else self.classes

    def core(self):
        width, classes = self.width, self.classes

        def run(block, w: np.ndarray, g: np.ndarray) -> float:
            x, costs, weight = block
            s = x.scores(w.reshape(-1, width)).reshape(-1, classes)
            allowed = np.isfinite(costs)
            p, z = _softmax(np.where(allowed, s, -np.inf))
            saved = np.where(allowed, np.where(allowed, costs, -np.inf).max(1, keepdims=True) - np.where(allowed, costs, 0), 0) * weight[:, None]
            x.push((saved.sum(1, keepdims=True) * p - saved).reshape(-1, width), g.reshape(-1, width))
            return float((saved * (z[:, None] - np.where(allowed, s, 0))).sum())

        return run

    def partial(self, b: pd.DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
        return of_frame(self.pack, self.core())(b, w)

    def fit(self, rows: DataFrame | Blocks, ridge: float, dev: DataFrame | Blocks | None = None, most: int = 100, dpp: float = 0.0, repeat: int = 1, init: np.ndarray | None = None, mean: np.ndarray | None = None, last: bool = False) -> Suite:
        """Weights near ``mean`` by ``ridge``, from ``init`` on.

        A run ends when the perplexity of a row falls by less than ``dpp``; it is ``repeat``ed from where it
        ended, with no memory of its steps.  With dev rows the weights of the best answers stay, the later
        of equals, unless the ``last`` are asked for."""
        centre = np.zeros_like(self.w) if mean is None else mean
        start, core, hits = self.w if init is None else init.copy(), self.core(), self.hits()

        def run(own, held):
            w, best = start, [-1.0, start]
            total = max(sum(own.told(lambda block: float(block[2].sum()))), 1e-12)

            def f(w):
                loss, g = own.summed(core, w)
                return loss + ridge / 2 * float((w - centre) @ (w - centre)), g + ridge * (w - centre)

            def watch(w, _):
                right = held.counted(hits, w)
                if right >= best[0]:
                    best[:] = [right, w.copy()]

            fewer = lambda a, b: 2.0 ** min(a / total / math.log(2), 1000) - 2.0 ** min(b / total / math.log(2), 1000) < dpp
            for _ in range(repeat):
                w, _ = lbfgs(f, w, memory=5, most=most, watch=watch if held is not None else None, stop=fewer if dpp else None)
            return best[1] if held is not None and not last and best[0] >= 0 else w

        with lent(rows, self.pack) as own, lent(dev, self.pack) as held:
            self.w = fitted(run, len(start), own, held)
        return self

    def hits(self):
        """Weight of a block's rows whose answer is a class of least cost, and of all."""
        width, classes = self.width, self.classes

        def run(block, v: np.ndarray) -> tuple[float, float]:
            x, costs, weight = block
            got = np.where(np.isfinite(costs), x.scores(v.reshape(-1, width)).reshape(-1, classes), -np.inf).argmax(1)
            right = costs[np.arange(len(costs)), got] == costs.min(1)
            return float(weight[right].sum()), float(weight.sum())

        return run

    def accuracy(self, rows: DataFrame | Blocks, w: np.ndarray | None = None) -> float:
        """Share of the rows' weight whose answer is a class of least cost."""
        with lent(rows, self.pack) as own:
            return own.counted(self.hits(), self.w if w is None else w)


def costs_of(label, classes: int):
    """0 for a row's label and 1 for the others."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 0.0).otherwise(1.0))


def halving(train: Callable[[float, np.ndarray | None], tuple[float, np.ndarray]], start: float, least: float = 2e-6, most: int = 20) -> tuple[float, np.ndarray]:
    """Halve the ridge, weights kept, until the dev error falls by less than ``least``."""
    ridge, w = start, None
    error, w = train(ridge, w)
    for _ in range(most):
        new, v = train(ridge / 2, w)
        if error - new < least:
            break
        ridge, error, w = ridge / 2, new, v
    return ridge, w


#: The latent model's blocks in the order of its weights, and those without weights by feature, hidden state and label.
LATENT = ("y", "h", "hy", "hx", "xy", "hxy")
PAIRED = LATENT[:5]


def latent_sizes(classes: int, hidden: int, features: int, on: tuple[str, ...]) -> list[int]:
    """Weights of each block, 0 for those that are off."""
    full = {"y": classes, "h": hidden, "hy": hidden * classes, "hx": features * hidden, "xy": features * classes, "hxy": features * hidden * classes}
    return [full[f] * (f in on) for f in LATENT]


def latent_blocks(w: np.ndarray, classes: int, hidden: int, on: tuple[str, ...] = PAIRED) -> dict[str, np.ndarray]:
    """Views of the weights by block: y, h, hy (hidden, labels), hx and xy by features first, hxy (features, hidden, labels)."""
    fixed, one = sum(latent_sizes(classes, hidden, 0, on)), sum(latent_sizes(classes, hidden, 1, on))
    n = (len(w) - fixed) // max(one - fixed, 1)
    shapes = {"y": (classes,), "h": (hidden,), "hy": (hidden, classes), "hx": (n, hidden), "xy": (n, classes), "hxy": (n, hidden, classes)}
    parts = np.split(w, np.cumsum(latent_sizes(classes, hidden, n, on))[:-1])
    return {f: p.reshape(shapes[f]) for f, p in zip(LATENT, parts, strict=True) if f in on}


#: The blocks by feature and those that are the same of a row as a whole.
BY_FEATURE = {"hx": "h", "xy": "y", "hxy": "hy"}


def _spread(classes: int, hidden: int) -> dict[str, np.ndarray | None]:
    """By block of features' weights, the matrix that takes them to every hidden state and label; none where they are that."""
    return {"hx": np.kron(np.eye(hidden), np.ones(classes)), "xy": np.kron(np.ones(hidden)[None], np.eye(classes)), "hxy": None}


def _latent_psi(x: Sparse, m: dict[str, np.ndarray], classes: int, hidden: int) -> np.ndarray:
    """Scores (hidden, labels, rows): a feature's weights are summed up before its rows are."""
    psi, own = np.zeros((hidden * classes, x.n)), None
    for f, by in _spread(classes, hidden).items():
        if f in m:
            v = x.own(m[f].reshape(len(m[f]), -1))
            v = v if by is None else v @ by
            own = v if own is None else own + v
        if BY_FEATURE[f] in m:
            v = m[BY_FEATURE[f]].reshape(-1)
            psi += (v if by is None else v @ by)[:, None]
    if own is not None:
        psi += x.of_feats(own).T
    return psi.reshape(hidden, classes, x.n)


def _latent_softmax(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over the first axis, with rows last so that each step goes over all of them."""
    top = s.max(0)
    e = np.exp(s - top)
    total = e.sum(0)
    e /= total
    return e, np.log(total) + top


def latent_core(classes: int, hidden: int, on: tuple[str, ...] = PAIRED):
    def run(block, w: np.ndarray, g: np.ndarray) -> float:
        x, y = block
        m, gm = latent_blocks(w, classes, hidden, on), latent_blocks(g, classes, hidden, on)
        psi = _latent_psi(x, m, classes, hidden)
        at = np.arange(x.n)
        own, zy = _latent_softmax(psi[:, y, at])
        flat, z = _latent_softmax(psi.reshape(-1, x.n))
        d = flat.reshape(psi.shape)
        d[:, y, at] -= own
        every, per = flat.sum(1), x.to_feats(flat.T)
        for f, by in _spread(classes, hidden).items():
            if BY_FEATURE[f] in gm:
                to = gm[BY_FEATURE[f]]
                to += (every if by is None else by @ every).reshape(to.shape)
            if f in gm:
                x.give(gm[f].reshape(len(gm[f]), -1), per if by is None else per @ by.T)
        return float((z - zy).sum())

    return run


def latent_partial(classes: int, hidden: int, on: tuple[str, ...] = PAIRED):
    return of_frame(labelled, latent_core(classes, hidden, on))


def latent_hits(classes: int, hidden: int, on: tuple[str, ...] = PAIRED):
    """Right answers of a block, and its rows: the label whose hidden states are the likeliest together."""

    def run(block, w: np.ndarray) -> tuple[float, float]:
        x, y = block
        psi = _latent_psi(x, latent_blocks(w, classes, hidden, on), classes, hidden)
        return float((np.exp(psi - psi.max((0, 1))).sum(0).argmax(0) == y).sum()), float(x.n)

    return run


def latent_fit(
    rows: DataFrame | Blocks, classes: int, features: int, hidden: int, ridge: float, most: int = 1500, seed: int = 1, on: tuple[str, ...] = PAIRED, dev: DataFrame | Blocks | None = None
) -> tuple[np.ndarray, float]:
    """Latent log-linear model with the blocks that are ``on``, from a seeded start in {-1, 0}.

    With dev data the weights of the strictly best dev accuracy after a round stay; without a right answer, the last ones."""
    w = np.random.default_rng(seed).integers(-1, 1, sum(latent_sizes(classes, hidden, features, on))).astype(float)

    def run(own, held):
        best: list = [0.0, None, np.inf]
        core, hits, waiting = latent_core(classes, hidden, on), latent_hits(classes, hidden, on), []

        def f(v):
            loss, g = own.summed(core, v)
            return loss + ridge / 2 * float(v @ v), add(g, ridge, v)

        def judged():
            for v, loss, share in waiting:
                right = share()
                if right > best[0]:
                    best[:] = [right, v.copy(), loss]
            waiting.clear()

        def watch(v, loss):
            judged()
            waiting.append((v, loss, held.later(hits, v)))  # the optimiser leaves ``v`` as it is

        last = lbfgs(f, w, most=most, watch=watch if held is not None else None)
        judged()
        return (best[1], best[2]) if best[1] is not None else last

    with lent(rows, labelled) as own, lent(dev, labelled) as held:
        return fitted(run, len(w), own, held, times=4, cores=min(cores_of(own.sc), 4))


def latent_tuned(rows: DataFrame, dev: DataFrame, classes: int, features: int, hidden: int, ridges: tuple[float, ...], **options) -> tuple[float, np.ndarray, float]:
    """The ridge of most right answers on dev data, of equals the first, with its weights and loss."""
    best: tuple = (-1.0, ridges[0], np.zeros(0), np.inf)
    with lent(rows, labelled) as own, lent(dev, labelled) as held:
        for ridge in ridges:
            w, loss = latent_fit(own, classes, features, hidden, ridge, dev=held, **options)
            right = held.counted(latent_hits(classes, hidden, options.get("on", PAIRED)), w)
            if right > best[0]:
                best = right, ridge, w, loss
    return best[1:]


def logistic(rows: DataFrame, features: int, ridge: float, target: Callable[[pd.DataFrame], np.ndarray], most: int = 50) -> np.ndarray:
    """Binary or binomial regression by conjugate gradient: targets lie in [0, 1]."""

    def slope(block, w: np.ndarray, g: np.ndarray) -> float:
        x, t = block
        s = x.scores(w[:, None])[:, 0]
        x.push((1 / (1 + np.exp(-s)) - t)[:, None], g[:, None])
        return float((np.logaddexp(0, s) - t * s).sum())

    def curvature(block, both: np.ndarray) -> tuple[float, float]:
        s = block[0].scores(both)
        p = 1 / (1 + np.exp(-s[:, 0]))
        return float((p * (1 - p) * s[:, 1] ** 2).sum()), 0.0

    def run(own):
        def f(w):
            loss, g = own.summed(slope, w)
            bend = lambda d: own.total(curvature, np.stack((w, d), 1)) + ridge * float(d @ d)
            return loss + ridge / 2 * float(w @ w), g + ridge * w, bend

        return conjugate_gradient(f, np.zeros(features), most)

    with lent(rows.select("label", "ids"), lambda b: (sparse(b["ids"], narrow=True), np.asarray(target(b), float))) as own:
        return fitted(run, features, own)


# order-dependent learners


def shards_of(rows: int, shards: int | None) -> int:
    return shards or max(1, math.ceil(rows / SHARD_ROWS))


class Average:
    """Weights with the average of their values after each row, from the updates alone.

    An update at row t counts T - t times of T, so that the average is the last value less the updates'
    sum weighted by t / T."""

    def __init__(self, w: np.ndarray):
        self.w, self.late = w, np.zeros_like(w)

    def add(self, at, change, t: int) -> None:
        np.add.at(self.w, at, change)
        np.add.at(self.late, at, t * change)

    def mean(self, n: int) -> np.ndarray:
        return self.w - self.late / max(n, 1)


Update = Callable[[np.ndarray, int, Average, int], tuple[int, bool]]


def _sharded(rows: DataFrame, shards: int | None, update: Update, shape: tuple[int, int], passes: int, seed: int, online: list | None = None) -> np.ndarray:
    """Passes over shards in a seeded order; shards' weights are averaged after each pass.

    ``update`` sees a row's ids and label, changes the weights, and gives its answer before that and
    whether it changed anything.  ``online`` collects a table of (rid, pass, pred) for each pass."""
    rows = rows.select("rid", "label", "ids").persist()
    n_shards = shards_of(rows.count(), shards)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(n_shards)))
    w, average, n = np.zeros(shape), np.zeros(shape), 0

    def one_pass(w: np.ndarray, p: int, answers: bool):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("rid").reset_index(drop=True)
            rng = np.random.default_rng([seed, p, int(g["shard"].iloc[0])])
            m, changed, said = Average(w.copy()), 0, np.zeros(len(g), np.int64)
            for t, i in enumerate(rng.permutation(len(g))):
                said[i], moved = update(np.asarray(g["ids"][i], np.int64), int(g["label"][i]), m, t)
                changed += moved
            if answers:
                return pd.DataFrame({"rid": g["rid"], "pass": p, "pred": said})
            return pd.DataFrame({"last": [m.w.tobytes()], "mean": [m.mean(len(g)).tobytes()], "updates": [changed]})

        return run

    for p in range(passes):
        if online is not None:
            online.append(dealt.groupBy("shard").applyInPandas(one_pass(w, p, True), "rid bigint, pass int, pred bigint"))
        out = dealt.groupBy("shard").applyInPandas(one_pass(w, p, False), "last binary, mean binary, updates bigint").collect()  # one row a shard
        w = np.mean([np.frombuffer(r["last"]) for r in out], axis=0).reshape(shape) if out else w
        average, n = average + (np.mean([np.frombuffer(r["mean"]) for r in out], axis=0).reshape(shape) if out else 0), n + 1
        if not sum(r["updates"] for r in out):
            break
    rows.unpersist()
    return average / max(n, 1)


def perceptron(rows: DataFrame, features: int, classes: int, passes: int = 5, seed: int = 1, shards: int | None = None, margin: bool = True) -> np.ndarray:
    """Averaged multiclass perceptron; on request wrong classes have a margin of 1 to clear. Ties go to the last class."""

    def update(x: np.ndarray, y: int, m: Average, t: int) -> tuple[int, bool]:
        s = m.w[x].sum(0)
        if margin:
            s = s + 1
            s[y] -= 1
        got = classes - 1 - int(s[::-1].argmax())
        if got != y:
            m.add((x, y), 1.0, t)
            m.add((x, got), -1.0, t)
        return got, got != y

    return _sharded(rows, shards, update, (features, classes), passes, seed)


def one_vs_rest(rows: DataFrame, features: int, classes: int, passes: int = 5, seed: int = 1, shards: int | None = None, online: list | None = None) -> np.ndarray:
    """A binary perceptron for each class, all in one pass: a class's weights move where it is on the wrong side of 0.

    The answer is the class of the highest score, ties to the last.  ``online`` collects the answers that were
    given before each update."""

    def update(x: np.ndarray, y: int, m: Average, t: int) -> tuple[int, bool]:
        s = m.w[x].sum(0)
        side = np.where(np.arange(classes) == y, 1.0, -1.0)
        wrong = s * side <= 0
        for c in np.flatnonzero(wrong):
            m.add((x, c), side[c], t)
        return classes - 1 - int(s[::-1].argmax()), bool(wrong.any())

    return _sharded(rows, shards, update, (features, classes), passes, seed, online)


def passive_aggressive(rows: DataFrame, features: int, classes: int, aggressiveness: float = 1.0, passes: int = 5, seed: int = 1, shards: int | None = None, compat: bool = False) -> np.ndarray:
    """PA-II; ``compat`` moves features by one and the bias alone by the computed step."""

    def update(x: np.ndarray, y: int, m: Average, t: int) -> tuple[int, bool]:
        s = m.w[x].sum(0)
        rest = np.where(np.arange(classes) == y, -np.inf, s)
        got = int(rest.argmax())
        loss = 1 - s[y] + rest[got]
        if loss > 0:
            tau = loss / (2 * len(x) + 1 / (2 * aggressiveness))
            move = np.where(x == 0, tau, 1.0) if compat else np.full(len(x), tau)
            m.add((x, y), move, t)
            m.add((x, got), -move, t)
        return int(s.argmax()), loss > 0

    return _sharded(rows, shards, update, (features, classes), passes, seed)


# sequence models


def lined_up(b: pd.DataFrame) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """A block of sequences: the items of all of them, their labels, and the sequences' bounds."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in b["gold"]]))).astype(np.int64)
    return sparse(np.asarray(i, np.int64) for x in b["ids"] for i in x), np.concatenate([np.asarray(x, np.int64) for x in b["gold"]]), bounds


def joined_lines(parts: list) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """One block of sequences of several."""
    sizes = np.concatenate([np.diff(bounds) for *_, bounds in parts])
    x, gold = joined([p[:2] for p in parts])
    return x, gold, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _crf_parts(w: np.ndarray, labels: int, features: int) -> list[np.ndarray]:
    """Views of the weights: states (features, labels), moves, begins and ends."""
    state, moves, begin, end = np.split(w, np.cumsum([features * labels, labels * labels, labels]))
    return [state.reshape(features, labels), moves.reshape(labels, labels), begin, end]


def crf_core(labels: int, features: int):
    def run(block, w: np.ndarray, g: np.ndarray) -> float:
        x, gold, bounds = block
        state, moves, begin, end = _crf_parts(w, labels, features)
        gs, gm, gb, ge = _crf_parts(g, labels, features)
        lat, s = Lattice(moves, begin, end), x.scores(state)
        b = Batch(s, bounds)
        fw, bw = b.forward(lat), b.backward(lat)
        norm = b.log_norms(lat, fw)
        z, first, at = np.repeat(norm, np.diff(bounds)), bounds[:-1], np.flatnonzero(~b.ends)
        node = np.exp(fw + bw - z[:, None])
        gm += np.exp(fw[at][:, :, None] + moves + (s[at + 1] + bw[at + 1])[:, None, :] - z[at][:, None, None]).sum(0)
        np.add.at(gm, (gold[at], gold[at + 1]), -1)
        right = np.arange(len(gold))
        node[right, gold] -= 1
        x.push(node, gs)
        gb += node[first].sum(0)
        ge += node[b.last].sum(0)
        return float(norm.sum() - s[right, gold].sum() - begin[gold[first]].sum() - end[gold[b.last]].sum() - moves[gold[at], gold[at + 1]].sum())

    return run


def crf_partial(labels: int, features: int):
    """Rows: ids (list of feature lists) and gold (list of labels) of a whole sequence."""
    return of_frame(lined_up, crf_core(labels, features))


def sequences(items: DataFrame) -> DataFrame:
    """(seq, ids, gold) from (seq, t, ids, label): one row a sequence, in order."""
    at = F.sort_array(F.collect_list(F.struct("t", "ids", "label")))
    return items.groupBy("seq").agg(at.alias("x")).select("seq", F.transform("x", lambda x: x["ids"]).alias("ids"), F.transform("x", lambda x: x["label"]).alias("gold"))


def crf_hits(labels: int, features: int):
    """Right labels of whole sequences by Viterbi, and how many labels there are."""

    def run(block, w: np.ndarray) -> tuple[float, float]:
        x, gold, bounds = block
        state, moves, begin, end = _crf_parts(w, labels, features)
        path, _ = Batch(x.scores(state), bounds).viterbi(Lattice(moves, begin, end))
        return float((path == gold).sum()), float(len(gold))

    return run


def crf_fit(rows: DataFrame, labels: int, features: int, sigma: float = 10.0, l1: bool = False, most: int = 100, held_out: DataFrame | None = None, report: list | None = None) -> tuple[np.ndarray, float]:
    """L2 with variance sigma squared, or L1 with 1 / sigma; stops as ten rounds gain less than 1e-5.

    ``report`` collects (round, loss, accuracy on ``held_out``), which has no say in the weights."""
    ridge = 0.0 if l1 else 1 / sigma**2
    size = features * labels + labels * labels + 2 * labels

    def run(own, held):
        said: list = []

        def f(w):
            loss, g = own.summed(crf_core(labels, features), w)
            return loss + ridge / 2 * float(w @ w), add(g, ridge, w)

        def watch(w, loss):
            said.append((len(said) + 1, float(loss), held.counted(crf_hits(labels, features), w) if held is not None else 0.0))

        return lbfgs(f, np.zeros(size), most=most, l1=1 / sigma if l1 else 0.0, past=10, watch=watch if asked else None), said

    asked = report is not None
    with lent(rows.select("ids", "gold"), lined_up) as own, lent(held_out.select("ids", "gold") if held_out is not None else None, lined_up) as held:
        out, said = fitted(run, size, own, held, join=joined_lines)
    if asked:
        report.extend(said)
    return out


class _Decayed:
    """Weights as a scale times a vector, so that a decay of all of them costs nothing."""

    def __init__(self, w: np.ndarray, features: int, labels: int):
        self.scale, self.v = 1.0, w.copy()
        cut = np.cumsum([features * labels, labels * labels, labels])
        state, moves, self.begin, self.end = np.split(self.v, cut)  # views
        self.state, self.moves = state.reshape(features, labels), moves.reshape(labels, labels)

    def lattice(self) -> Lattice:
        return Lattice(self.scale * self.moves, self.scale * self.begin, self.scale * self.end)

    def step(self, ids: list[np.ndarray], gold: np.ndarray, rate: float, ridge: float) -> float:
        """One sequence: its loss before the step."""
        lat = self.lattice()
        s = self.scale * np.stack([self.state[x].sum(0) for x in ids])
        fw, bw = lat.forward(s), lat.backward(s)
        z = float(np.logaddexp.reduce(fw[-1] + lat.end))
        loss = z - lat.path_score(s, gold)
        self.scale *= 1 - rate * ridge
        by = rate / self.scale
        d = np.exp(fw + bw - z)
        d[np.arange(len(gold)), gold] -= 1
        for x, row in zip(ids, d, strict=True):
            np.add.at(self.state, x, -by * row)
        for t in range(1, len(s)):
            self.moves -= by * np.exp(fw[t - 1][:, None] + lat.moves + (s[t] + bw[t])[None] - z)
            self.moves[gold[t - 1], gold[t]] += by
        self.begin -= by * d[0]
        self.end -= by * d[-1]
        return loss

    def weights(self) -> np.ndarray:
        return self.scale * self.v


def _sequence_pass(g: pd.DataFrame, w: np.ndarray, features: int, labels: int, order: np.ndarray, rate: Callable[[int], float], ridge: float) -> tuple[np.ndarray, float]:
    m, loss = _Decayed(w, features, labels), 0.0
    for k, i in enumerate(order):
        ids, gold = [np.asarray(x, np.int64) for x in g["ids"][i]], np.asarray(g["gold"][i], np.int64)
        loss += m.step(ids, gold, rate(k), ridge)
    v = m.weights()
    return v, loss


def calibrated(sample: pd.DataFrame, labels: int, features: int, ridge: float, start: float = 0.1, candidates: int = 10, by: float = 2.0) -> float:
    """The learning rate of least loss after a pass over a sample: from ``start`` on, times ``by`` while that
    helps, else divided by it; at most ``candidates`` rates are tried."""
    tail = np.arange(len(sample))
    zero = np.zeros(features * labels + labels * labels + 2 * labels)

    def after(rate: float) -> float:
        with np.errstate(over="ignore", invalid="ignore"):
            w, _ = _sequence_pass(sample, zero, features, labels, tail, lambda k: rate / (1 + rate * ridge * k), ridge)
            loss, _ = crf_partial(labels, features)(sample, w)
        return loss if np.isfinite(loss) else np.inf

    best, rate, tried = after(start), start, 1
    for factor in (by, 1 / by):
        while tried < candidates:
            loss, tried = after(rate * factor), tried + 1
            if loss >= best:
                break
            best, rate = loss, rate * factor
        if rate != start:
            break
    return rate


def crf_sgd(rows: DataFrame, labels: int, features: int, sigma: float = 10.0, passes: int = 10, rate: float | None = None, seed: int = 1, shards: int | None = None, sample: int = 1000, period: int = 10, delta: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and loss by stochastic gradient with a falling rate over shards of sequences, mixed after each pass.

    Without a ``rate`` it is calibrated on at most ``sample`` sequences, those of smallest hash.  The pass
    of least loss stays; passes end when ``period`` of them have gained less than ``delta`` of the loss."""
    rows = rows.persist()
    n = max(rows.count(), 1)
    n_shards, ridge = shards_of(n, shards), 1 / (sigma**2 * n)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(n_shards)))
    w = np.zeros(features * labels + labels * labels + 2 * labels)
    if rate is None:
        some = rows.orderBy(F.xxhash64("seq"), "seq").limit(sample).toPandas()
        rate = calibrated(some, labels, features, ridge) if len(some) else 0.1

    def one_pass(w: np.ndarray, p: int):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("seq").reset_index(drop=True)
            order = np.random.default_rng([seed, p, int(g["shard"].iloc[0])]).permutation(len(g))
            v, loss = _sequence_pass(g, w, features, labels, order, lambda k: rate / (1 + rate * ridge * (p * len(g) + k)), ridge)
            return pd.DataFrame({"w": [v.tobytes()], "loss": [loss]})

        return run

    best, history = (np.inf, w), []
    for p in range(passes):
        out = dealt.groupBy("shard").applyInPandas(one_pass(w, p), "w binary, loss double").collect()  # one row a shard
        if not out:
            break
        w = np.mean([np.frombuffer(r.w) for r in out], axis=0)
        loss = sum(r.loss for r in out) + ridge * n / 2 * float(w @ w)
        history.append(loss)
        if loss < best[0]:
            best = (loss, w)
        if len(history) > period and (history[-1 - period] - loss) / max(abs(loss), 1e-12) < delta:
            break
    rows.unpersist()
    return best[1], best[0]


# sampling


def metropolis_log_partition(scores: np.ndarray, log_q: np.ndarray, burn: int = 100, n: int = 500, spacing: int = 50, seed: int = 1) -> np.ndarray:
    """Visits of an independence sampler over proposals: the kept states, in order."""
    rng = np.random.default_rng(seed)
    p = np.exp(log_q - np.logaddexp.reduce(log_q))
    at, kept = int(rng.choice(len(p), p=p)), []
    for step in range(burn + n * spacing):
        new = int(rng.choice(len(p), p=p))
        if math.log(max(rng.random(), 1e-300)) < scores[new] - log_q[new] - scores[at] + log_q[at]:
            at = new
        if step >= burn and (step - burn) % spacing == spacing - 1:
            kept.append(at)
    return np.array(kept)
