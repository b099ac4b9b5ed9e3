"""Queries: training.  They depend on iteration or chance, so rows and properties are tested, not SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from turnloom.operators import encode as E
from turnloom.operators import grammar as G
from turnloom.operators import learn as N
from turnloom.operators import optimise as O
from turnloom.operators import select as S
from turnloom.operators.order import first_seen_ids
from turnloom.plans.data_queries import lines_of
from turnloom.plans.registry import query
from turnloom.sources.feature_text import grammar_rules
from turnloom.sources.shared import release, written
from turnloom.sources.units import table, unit_key, units


def _data(spark, d, least: int = 3):
    """Packed rows over features of ``least`` occurrences, and the sizes of the model; written once, as training reads them again."""
    x = written(E.instances(spark, d), "instances")
    ids = written(E.frequent_dictionary(x, least), "dictionary")
    packed, n = E.packed(x, ids)
    rows = written(packed, "packed")
    release(x, ids)
    return rows, n


def _splits(rows):
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


def _report(spark, **values):
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in sorted(values.items())], "measure string, value double")


@query("maxent_train")
def maxent_train(spark, d):
    rows, n = _data(spark, d)
    train, rest = map(N.MaxEnt.packed, _splits(rows))
    m = N.MaxEnt(4, n).fit(train, 1.0, dev=rest)
    return _report(spark, train=m.accuracy(train), dev=m.accuracy(rest))


@query("maxent_grid")
def maxent_grid(spark, d):
    """Best ridge of a grid by dev accuracy; of equals the first."""
    rows, n = _data(spark, d)
    train, rest = map(N.MaxEnt.packed, _splits(rows))
    found = [(r, N.MaxEnt(4, n).fit(train, r).accuracy(rest)) for r in (0.1, 1.0, 10.0)]
    best = max(a for _, a in found)
    return spark.createDataFrame([(r, float(a), r == next(x for x, y in found if y == best)) for r, a in found], "ridge double, accuracy double, best boolean")


@query("tune_halving")
def tune_halving(spark, d):
    rows, n = _data(spark, d)
    train, rest = map(N.MaxEnt.packed, _splits(rows))

    def fit(ridge, w):
        m = N.MaxEnt(4, n)
        m.w = m.w if w is None else w
        m.fit(train, ridge)
        return 1 - m.accuracy(rest), m.w

    ridge, _ = N.halving(fit, 8.0)
    return _report(spark, ridge=ridge)


@query("logit_binary")
def logit_binary(spark, d):
    rows, n = _data(spark, d)
    w = N.logistic(rows.where("split = 'train'"), n, 1.0, lambda b: (b["label"].to_numpy() >= 2).astype(float))
    return _report(spark, norm=np.linalg.norm(w), bias=w[0])


@query("logit_binomial")
def logit_binomial(spark, d):
    rows, n = _data(spark, d)
    w = N.logistic(rows.where("split = 'train'"), n, 1.0, lambda b: b["label"].to_numpy() / 3.0)
    return _report(spark, norm=np.linalg.norm(w), bias=w[0])


@query("lll_train")
def lll_train(spark, d):
    rows, n = _data(spark, d, 8)
    train, rest = _splits(rows)
    w, loss = N.latent_fit(train, 4, n, 2, 1.0, on=N.LATENT, dev=rest)
    return _report(spark, loss=loss, norm=np.linalg.norm(w))


def _hits(rows, m):
    def run(b, v):
        ids, row, y = N._flat(b)
        hit = N._scores(ids, row, len(b), v.reshape(m.shape)).argmax(1) == y
        return float(hit.sum()), np.concatenate(([len(b)], np.zeros(len(v) - 1)))

    right, n = N.summed(rows.select("label", "ids"), run, m.reshape(-1))
    return right / max(n[0], 1)


def _suite_rows(rows):
    one = F.transform("ids", lambda x: F.lit(1.0))
    return rows.select("rid", "split", "label", "ids", one.alias("vals"), N.costs_of(F.col("label"), 4).alias("costs"), F.lit(1.0).alias("weight"))


def _fitted(suite, rows, ridge):
    """Accuracy of a model on the rows it is fitted to."""
    own = suite.packed(rows)
    right = suite.fit(own, ridge).accuracy(own)
    own.release()
    return right


@query("suite_train")
def suite_train(spark, d):
    """Multiclass training in every layout: features with values, row weights, a list a class, costs, and adaptation.

    The fits that do not need one another go on at the same time."""
    rows, n = _data(spark, d, 8)
    x = _suite_rows(rows)
    train, rest = _splits(x)

    def plain():
        m = N.Suite(4, n)
        own, held = m.packed(train), m.packed(rest)
        right = m.fit(own, 1.0, dev=held).accuracy(own)
        own.release()
        few = train.where("rid % 3 = 0")
        return right, N.Suite(4, n).fit(few, 5.0, init=m.w, mean=m.w, dpp=1e-4, repeat=2).accuracy(held)

    shares = train.withColumn("vals", F.transform("ids", lambda i: 1.0 / F.size("ids")))
    heavy = train.withColumn("weight", F.when(F.col("label") == 0, 3.0).otherwise(1.0))
    lists = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda c: F.transform("ids", lambda i: c * n + i))
    listed = train.withColumn("vals", F.array_repeat("vals", 4)).withColumn("ids", lists)
    costly = train.withColumn("costs", F.transform("costs", lambda c, i: F.when(i == (F.col("label") + 2) % 4, float("inf")).otherwise(c * (1 + F.abs(i - F.col("label"))))))
    fits = {"values": (N.Suite(4, n), shares, 0.1), "weights": (N.Suite(4, n), heavy, 1.0), "explicit": (N.Suite(4, 4 * n, explicit=True), listed, 1.0), "costs": (N.Suite(4, n), costly, 1.0)}
    with ThreadPoolExecutor(len(fits) + 1) as pool:
        both = pool.submit(plain)
        own = {k: pool.submit(_fitted, *fit) for k, fit in fits.items()}
        implicit, adapted = both.result()
        return _report(spark, implicit=implicit, adapted=adapted, **{k: v.result() for k, v in own.items()})


@query("crf_held_out")
def crf_held_out(spark, d):
    """Loss and accuracy on a fifth of the conversations after each round."""
    seqs, n = _items(spark, d)
    fifth = F.pmod(F.xxhash64("seq"), F.lit(5)) == 0
    report: list = []
    N.crf_fit(seqs.where(~fifth), 3, n, most=20, held_out=seqs.where(fifth), report=report)
    return spark.createDataFrame([(k, round(float(l), 6), round(float(a), 6)) for k, l, a in report], "round int, loss double, accuracy double")


@query("perceptron")
def perceptron(spark, d):
    rows, n = _data(spark, d)
    two = rows.withColumn("label", (F.col("label") >= 2).cast("int"))
    m = N.perceptron(two.where("split = 'train'"), n, 2, margin=False)
    return _report(spark, train=_hits(two.where("split = 'train'"), m))


@query("multitron")
def multitron(spark, d):
    rows, n = _data(spark, d)
    m = N.perceptron(rows.where("split = 'train'"), n, 4)
    return _report(spark, train=_hits(rows.where("split = 'train'"), m))


@query("one_vs_rest")
def one_vs_rest(spark, d):
    """Perceptrons of one label against the others, with the share of right answers given before each update, by pass."""
    rows, n = _data(spark, d)
    train, online = rows.where("split = 'train'"), []
    m = N.one_vs_rest(train, n, 4, online=online)
    out = [("train", round(float(_hits(train, m)), 6))]
    for p, answers in enumerate(online):
        right = answers.join(train.select("rid", "label"), "rid").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
        out.append((f"online_{p}", round(float(right or 0), 6)))
    return spark.createDataFrame(out, "measure string, value double")


@query("passive_aggressive")
def passive_aggressive(spark, d):
    rows, n = _data(spark, d)
    m = N.passive_aggressive(rows.where("split = 'train'"), n, 4)
    return _report(spark, train=_hits(rows.where("split = 'train'"), m))


def _items(spark, d, names: bool = False):
    """Sequences of turns with the ids of their words and their roles; the words in order of their ids on request."""
    at = unit_key(F.col("dyad"), F.col("pos"))
    role = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    u = units(spark, d).select(F.col("dyad").alias("seq"), F.col("pos").alias("t"), at.alias("p"), role.alias("label"), F.array_distinct("toks").alias("feats"))
    rows = written(u.withColumn("row", F.monotonically_increasing_id()), "turns")
    ids = written(first_seen_ids(rows.select("p", F.explode("feats").alias("f")), "f", "p"), "words")
    n, few = E.sized(ids)
    if few:
        each = E.looked_up(rows.select("seq", "t", "label", "feats"), ids, bias=False)
    else:
        per = rows.select("row", F.explode("feats").alias("f")).join(ids, "f").groupBy("row").agg(F.collect_list("id").alias("ids"))
        each = rows.join(per, "row", "left").select("seq", "t", "label", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
    seqs = written(N.sequences(each), "sequences")
    release(rows)
    return (seqs, n, [r.f for r in ids.orderBy("id").collect()]) if names else (seqs, n)


@query("crf_train")
def crf_train(spark, d):
    seqs, n = _items(spark, d)
    w, loss = N.crf_fit(seqs, 3, n)
    return _report(spark, loss=loss, norm=np.linalg.norm(w))


@query("crf_train_l1")
def crf_train_l1(spark, d):
    seqs, n = _items(spark, d)
    w, loss = N.crf_fit(seqs, 3, n, sigma=2.0, l1=True)
    return _report(spark, loss=loss, nonzero=np.count_nonzero(w))


@query("crf_sgd")
def crf_sgd(spark, d):
    seqs, n = _items(spark, d)
    w, loss = N.crf_sgd(seqs, 3, n)
    return _report(spark, loss=loss, norm=np.linalg.norm(w))


@query("model_roundtrip")
def model_roundtrip(spark, d):
    """A model written as text lines with 20 decimals, bias first, and read back."""
    rows, n = _data(spark, d, 8)
    m = N.MaxEnt(4, n).fit(rows.where("split = 'train'"), 1.0, most=5)
    t = m.table(spark)
    line = F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "w"))), lambda x: F.format_string("%.20f", x["w"])), "\t"))
    text = t.groupBy("id").agg(line.alias("value"))
    f = F.split("value", "\t")
    back = text.select(F.get(f, F.lit(0)).cast("bigint").alias("id"), F.posexplode(F.slice(f, F.lit(2), F.size(f))).alias("c", "v"))
    both = t.join(back, ["id", "c"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("w") - F.col("v").cast("double"))).alias("off"))
    return both.select("n", F.round("off", 12).alias("off"))


@query("lbfgs_search")
def lbfgs_search(spark, d):
    """Ridge regression of each embedding's last entry on the others by every line search, against the exact solution."""
    rows = table(spark, d, "embeddings").select("embedding")

    def moments(batches):
        total = 0.0
        for b in batches:
            if len(b):
                v = np.stack(b["embedding"].to_numpy()).astype(float)
                total = total + v.T @ v
        if np.ndim(total):
            yield pd.DataFrame({"m": [total.tobytes()]})

    found = [np.frombuffer(r.m) for r in rows.mapInPandas(moments, "m binary").collect()]  # one matrix a partition
    m = sum(found)
    k = int(np.sqrt(len(m)))
    m = m.reshape(k, k)
    a, b = m[:-1, :-1] + np.eye(k - 1), m[:-1, -1]
    exact = np.linalg.solve(a, b)
    out = []
    for name in ("armijo", "wolfe", "strong", "more-thuente"):
        x, _ = O.lbfgs(lambda w: (float(w @ a @ w / 2 - b @ w), a @ w - b), np.zeros(k - 1), most=500, eps=1e-9, search=name)
        out.append((name, round(float(np.abs(x - exact).max()), 5)))
    return spark.createDataFrame(out, "search string, off double")


@query("density")
def density(spark, d):
    """A sampler's visits to proposals, the codes of units by their share, against their exact shares under scores."""
    u = units(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("score")).orderBy("code").collect()  # as many as codes
    n, scores = np.array([float(r.n) for r in u]), np.array([r.score / 20 for r in u])
    seen = N.metropolis_log_partition(scores, np.log(n / n.sum()), n=2000, spacing=5)
    exact = np.exp(scores - np.logaddexp.reduce(scores))
    return spark.createDataFrame([(r.code, float((seen == k).mean()), float(exact[k])) for k, r in enumerate(u)], "code string, share double, exact double")


@query("kernelmap")
def kernelmap(spark, d):
    """Features of each vector along orthogonal directions between far pairs of a seeded sample."""
    return S.kernel_map(spark.read.parquet(f"{d}/embeddings.parquet"), 5, seed=1)


@query("abffs")
def abffs(spark, d):
    """Features added round by round by their approximate gain."""
    x = E.instances(spark, d).where("split = 'train'").withColumn("label", (F.col("label") >= 2).cast("int"))
    return S.greedy_features(E.long_form(x).select("rid", "f"), x.select("rid", "label"), rounds=3, per_round=3)


_TOY, _TOY_SQL = lines_of("1 S --> NP VP", "2 NP --> Det N", "1 NP --> N", "1 VP --> V NP", "1 VP --> V", "1 Det --> the", "1 N --> dog", "1 N --> cat", "1 V --> sees", "1 V --> runs")
_SENTENCES, _ = lines_of("the dog sees the cat", "the cat runs", "dog sees cat", "the dog runs", "cat sees the dog")


def _toy(spark):
    """A grammar and sentences from their files; every chart holds both."""
    rules = G.normalised([(r.weight, r.parent, r.children) for r in grammar_rules(_TOY(spark)).orderBy("pos").collect()])
    return rules, [r.value for r in _SENTENCES(spark).orderBy("pos").collect()]


@query(
    "pcfg_inside",
    """with np(s, p) as (values ('the dog', 2.0 / 3 * 0.5), ('the cat', 2.0 / 3 * 0.5), ('dog', 1.0 / 3 * 0.5), ('cat', 1.0 / 3 * 0.5)), v(s, p) as (values ('sees', 0.5), ('runs', 0.5)),
vp as (select v.s || ' ' || np.s as s, 0.5 * v.p * np.p as p from v, np union all select s, 0.5 * p from v), all_of as (select np.s || ' ' || vp.s as s, np.p * vp.p as p from np, vp)
select s as sentence, cast(p as double) as p from all_of where s in ('the dog sees the cat', 'the cat runs', 'dog sees cat', 'the dog runs', 'cat sees the dog')""",
)
def pcfg_inside(spark, d):
    """Probability of each sentence under a normalised grammar."""
    rules, sentences = _toy(spark)
    return spark.createDataFrame([(s, G.Chart(rules, tuple(s.split())).inside("S", 0, len(s.split()))) for s in sentences], "sentence string, p double")


@query("adaptor_gibbs")
def adaptor_gibbs(spark, d):
    """Two chains of an adapted grammar over the sentences."""
    rules, sentences = _toy(spark)
    return G.chains(spark, rules, "S", sentences, ("NP",), 5, [1, 2])
