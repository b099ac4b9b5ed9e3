"""Learners against plain versions of themselves, exact optima and properties."""

import itertools
import math
import os

import numpy as np
import pandas as pd
import pytest

from turnloom.operators import blocks, learn, optimise, select
from turnloom.plans import registry

KIND = "rid bigint, split string, label int, ids array<bigint>"


def noisy(n=60, classes=3, seed=4):
    rng = np.random.default_rng(seed)
    return [(i, "train" if i % 5 else "dev", (y := int(rng.integers(classes))), sorted({0, 1 + (y if rng.random() < 0.8 else int(rng.integers(classes))), 4 + int(rng.integers(4))})) for i in range(n)]


def plain_average(rows, features, classes, rule, passes, seed=1):
    """Dense averages over one shard: the weights after every row are summed up."""
    w, average, done = np.zeros((features, classes)), np.zeros((features, classes)), 0
    rows = sorted(rows)
    for p in range(passes):
        total, changed = np.zeros_like(w), 0
        for i in np.random.default_rng([seed, p, 0]).permutation(len(rows)):
            _, _, y, x = rows[i]
            before = w.copy()
            rule(w, x, y, classes)
            changed += not np.array_equal(before, w)
            total += w
        average, done = average + total / len(rows), done + 1
        if not changed:
            break
    return average / done


def perceptron_rule(w, x, y, classes):
    s = w[x].sum(0) + 1
    s[y] -= 1
    got = max(range(classes), key=lambda c: (s[c], c))
    if got != y:
        for f in x:
            w[f, y] += 1
            w[f, got] -= 1


def rest_rule(w, x, y, classes):
    s = w[x].sum(0)
    for c in range(classes):
        side = 1 if c == y else -1
        if s[c] * side <= 0:
            for f in x:
                w[f, c] += side


def aggressive_rule(w, x, y, classes):
    s = w[x].sum(0)
    got = max((c for c in range(classes) if c != y), key=lambda c: (s[c], -c))
    loss = 1 - s[y] + s[got]
    if loss > 0:
        tau = loss / (2 * len(x) + 0.5)
        for f in x:
            w[f, y] += tau
            w[f, got] -= tau


@pytest.mark.parametrize("fit,rule", [(learn.perceptron, perceptron_rule), (learn.one_vs_rest, rest_rule), (learn.passive_aggressive, aggressive_rule)])
def test_lazy_averages_are_the_averages(spark, fit, rule):
    rows = noisy()
    df = spark.createDataFrame(rows, KIND)
    assert np.allclose(fit(df, 8, 3, passes=3, shards=1), plain_average(rows, 8, 3, rule, 3))
    mixed = fit(df, 8, 3, passes=3, shards=4)
    hits = sum(int(mixed[x].sum(0).argmax()) == y for _, _, y, x in rows)
    assert hits > 0.6 * len(rows)


def test_shards_are_bounded():
    assert learn.shards_of(0, None) == 1 and learn.shards_of(10 * learn.SHARD_ROWS + 1, None) == 11 and learn.shards_of(99, 3) == 3


def test_online_answers(spark):
    df, online = spark.createDataFrame(noisy(), KIND), []
    learn.one_vs_rest(df, 8, 3, passes=2, online=online)
    for answers in online:
        got = answers.collect()
        assert sorted(r.rid for r in got) == list(range(60)) and {r.pred for r in got} <= {0, 1, 2}
    assert len(online) == 2


def test_maxent_at_its_optimum(spark):
    df = spark.createDataFrame(noisy(), KIND)
    m = learn.MaxEnt(3, 8).fit(df, 0.5)
    _, g = learn.summed(df.select("label", "ids"), learn.maxent_partial(3), m.w)
    assert np.abs(g + 0.5 * m.w).max() < 1e-2
    (a, b) = (m.accuracy(df), np.mean([r.pred == y for r, (_, _, y, _) in zip(sorted(m.predict(df).collect()), sorted(noisy()), strict=True)]))
    assert abs(a - b) < 1e-9


def test_binary_and_binomial_against_newton(spark):
    rows = noisy(80)
    df = spark.createDataFrame(rows, KIND)
    for target in (lambda y: np.minimum(y, 1.0), lambda y: y / 2.0):
        w = learn.logistic(df, 8, 0.7, lambda b, t=target: t(b["label"].to_numpy()), most=200)
        x = np.zeros((80, 8))
        for i, (_, _, _, ids) in enumerate(rows):
            x[i, ids] = 1
        t, v = target(np.array([y for _, _, y, _ in rows])), np.zeros(8)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ v))
            v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.7 * np.eye(8), x.T @ (p - t) + 0.7 * v)
        assert np.allclose(w, v, atol=1e-4)


def test_latent_fit_falls_to_a_flat_place(spark):
    df = spark.createDataFrame(noisy(40), KIND)
    w, loss = learn.latent_fit(df, 3, 8, 2, 0.5, most=300)
    value, g = learn.summed(df.select("label", "ids"), learn.latent_partial(3, 2), w)
    start = np.random.default_rng(1).integers(-1, 1, len(w)).astype(float)
    first, _ = learn.summed(df.select("label", "ids"), learn.latent_partial(3, 2), start)
    assert np.abs(g + 0.5 * w).max() < 0.05 and loss < first + 0.25 * float(start @ start) and abs(loss - value - 0.25 * float(w @ w)) < 1e-6


def chains(n=30):
    rng = np.random.default_rng(8)
    out = []
    for k in range(n):
        y = [int(rng.integers(2))]
        for _ in range(int(rng.integers(1, 6))):
            y.append(y[-1] if rng.random() < 0.8 else 1 - y[-1])
        out.append((f"s{k:02}", [[t if rng.random() < 0.85 else 1 - t, 2 + int(rng.integers(3))] for t in y], y))
    return out


def plain_loss(rows, w, labels, features):
    """Negative log-likelihood over all label paths."""
    state, moves, begin, end = np.split(w, np.cumsum([features * labels, labels * labels, labels]))
    state, moves = state.reshape(features, labels), moves.reshape(labels, labels)

    def score(ids, y):
        return begin[y[0]] + end[y[-1]] + sum(state[x, c].sum() for x, c in zip(ids, y, strict=True)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))

    return sum(np.logaddexp.reduce([score(ids, p) for p in itertools.product(range(labels), repeat=len(y))]) - score(ids, y) for _, ids, y in rows)


def test_sequence_learners(spark):
    rows = chains()
    df = spark.createDataFrame(rows, "seq string, ids array<array<bigint>>, gold array<bigint>")
    w, loss = learn.crf_fit(df, 2, 5, sigma=3.0)
    ridge = lambda v: float(v @ v) / 18
    assert abs(plain_loss(rows, w, 2, 5) + ridge(w) - loss) < 1e-6
    rng = np.random.default_rng(1)
    assert all(plain_loss(rows, w + d, 2, 5) + ridge(w + d) > loss - 1e-4 for d in rng.normal(size=(20, len(w))) * 0.05)
    v, l1 = learn.crf_fit(df, 2, 5, sigma=1.0, l1=True)
    assert (v == 0).sum() > 4 and abs(plain_loss(rows, v, 2, 5) + np.abs(v).sum() - l1) < 1e-6
    u, _ = learn.crf_sgd(df, 2, 5, sigma=3.0, passes=30)
    assert plain_loss(rows, u, 2, 5) + ridge(u) < loss * 1.25
    few, _ = learn.crf_sgd(df, 2, 5, sigma=3.0, passes=30, shards=3)
    assert plain_loss(rows, few, 2, 5) + ridge(few) < loss * 1.5


def test_calibration_takes_the_best_rate():
    g = pd.DataFrame(chains(), columns=["seq", "ids", "gold"])
    after = {}
    for r in (0.1, learn.calibrated(g, 2, 5, 0.01)):
        w, _ = learn._sequence_pass(g, np.zeros(18), 5, 2, np.arange(len(g)), lambda k, r=r: r / (1 + r * 0.01 * k), 0.01)
        after[r] = learn.crf_partial(2, 5)(g, w)[0]
    assert min(after, key=after.get) == list(after)[-1]


@pytest.mark.parametrize("search", ["armijo", "wolfe", "strong", "more-thuente"])
def test_line_searches(search):
    def f(x):
        r = x[1:] - x[:-1] ** 2
        g = np.zeros_like(x)
        g[:-1] += -40 * x[:-1] * r - 2 * (1 - x[:-1])
        g[1:] += 20 * r
        return float(10 * (r**2).sum() + ((1 - x[:-1]) ** 2).sum()), g

    x, loss = optimise.lbfgs(f, np.zeros(8), most=400, eps=1e-8, search=search)
    assert np.allclose(x, 1, atol=1e-4) and loss < 1e-8


def test_more_thuente_steps():
    """Sufficient decrease and a small slope on functions with bumps, from short and long first steps."""
    bumpy = lambda t: (float(-t / (t * t + 2)), float((t * t - 2) / (t * t + 2) ** 2))
    steep = lambda t: (float((t + 0.004) ** 5 - 2 * (t + 0.004) ** 4), float(5 * (t + 0.004) ** 4 - 8 * (t + 0.004) ** 3))
    for f, ftol, gtol in ((bumpy, 1e-3, 0.1), (steep, 0.1, 0.1)):
        f0, g0 = f(0.0)
        for first in (1e-3, 0.1, 10.0, 1000.0):
            t = optimise.more_thuente(f, f0, g0, first, ftol, gtol, most=80)
            v, s = f(t)
            assert t > 0 and v <= f0 + ftol * t * g0 + 1e-12 and abs(s) <= gtol * abs(g0) + 1e-9


def test_sampler_visits_states_by_their_share():
    scores, log_q = np.array([0.0, 1.0, 2.0, 0.5]), np.log(np.array([0.4, 0.3, 0.2, 0.1]))
    seen = learn.metropolis_log_partition(scores, log_q, n=4000, spacing=5)
    exact = np.exp(scores - np.logaddexp.reduce(scores))
    assert np.abs(np.bincount(seen, minlength=4) / len(seen) - exact).max() < 0.03


def test_kernel_map_keeps_projections(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    out = select.kernel_map(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 3, seed=1).toPandas()
    m = out.pivot(index="vec_id", columns="k", values="value").to_numpy()
    x = np.array([v for _, v in rows])
    basis = np.linalg.lstsq(x, m, rcond=None)[0]
    assert m.shape == (40, 3) and np.allclose(x @ basis, m) and np.allclose(basis.T @ basis, np.eye(3), atol=1e-6)


def test_greedy_features_find_what_tells_labels_apart(spark):
    rng = np.random.default_rng(6)
    gold = [(i, i % 2) for i in range(200)]
    long = [(i, f"noise{int(rng.integers(30))}") for i, _ in gold] + [(i, "good") for i, y in gold if y] + [(i, "fair") for i, y in gold if y or i % 10 == 0]
    out = select.greedy_features(spark.createDataFrame(long, "rid bigint, f string"), spark.createDataFrame(gold, "rid bigint, label int"), 2, 1).collect()
    assert [(r.round, r.f) for r in out][0] == (0, "good") and len(out) == 2


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("talk"))
    rng = np.random.default_rng(3)
    words = ["offer", "price", "one", "two", "yes", "no", "brand", "store"]
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(words, int(rng.integers(2, 60))))) for c in range(12) for t in range(6)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, rows


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_training_queries(spark, small, monkeypatch):
    """Queries end to end, with few rounds a fit: fits to the end are tested above."""
    d, _ = small
    q = registry.queries()
    for kind in (learn.MaxEnt, learn.Suite):
        monkeypatch.setattr(kind, "fit", lambda self, *a, f=kind.fit, **k: f(self, *a, **{"most": 8, **k}))
    logistic = learn.logistic
    monkeypatch.setattr(learn, "logistic", lambda *a: logistic(*a, most=5))
    assert set(values(q["suite_train"](spark, d))) == {"implicit", "values", "weights", "explicit", "costs", "adapted"}
    held = q["crf_held_out"](spark, d).orderBy("round").collect()
    assert held and all(a.loss >= b.loss for a, b in zip(held, held[1:], strict=False))
    assert values(q["maxent_train"](spark, d))["train"] > 0.4
    grid = q["maxent_grid"](spark, d).collect()
    assert [r.best for r in grid].count(True) == 1 and max(grid, key=lambda r: r.accuracy).accuracy == next(r.accuracy for r in grid if r.best)
    assert values(q["tune_halving"](spark, d))["ridge"] in {8.0 / 2**k for k in range(21)}
    assert values(q["logit_binary"](spark, d))["norm"] > 0 and values(q["logit_binomial"](spark, d))["norm"] > 0
    assert values(q["one_vs_rest"](spark, d))["train"] > 0.4
    assert all(r.off < 1e-3 for r in q["lbfgs_search"](spark, "/root/testdata/sf0.001").collect())
    assert {r.off for r in q["model_roundtrip"](spark, d).collect()} == {0.0}


def test_other_queries_without_sql(spark, small):
    d, rows = small
    q = registry.queries()
    assert values(q["sink_partitioned"](spark, d)) == {str(c): 6 for c in range(12)}
    spark.createDataFrame([(1, 0, "user", "I can't say \"no\", but they'll (maybe) cannot...")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/tb/conversations.parquet")
    (r,) = q["tokenize_tb"](spark, f"{d}/tb").collect()
    assert r.unit == "I ca n't say `` no '' , but they 'll ( maybe ) can not ..."


def suite_rows(rows, classes=3):
    return [(i, x, [1.0] * len(x), [0.0 if c == y else 1.0 for c in range(classes)], 1.0) for i, _, y, x in rows]


SUITE = "rid bigint, ids array<bigint>, vals array<double>, costs array<double>, weight double"


def test_suite_layouts_agree(spark):
    """One model by every layout that can say it: the plain learner, values, row weights and a list a class."""
    rows = suite_rows(noisy())
    plain = learn.MaxEnt(3, 8).fit(spark.createDataFrame(noisy(), KIND), 0.5, most=300)
    same = lambda w: np.allclose(w, plain.w, atol=2e-3)
    assert same(learn.Suite(3, 8).fit(spark.createDataFrame(rows, SUITE), 0.5, most=300).w)
    halves = [(i, x, v, c, 0.5) for i, x, v, c, _ in rows for _ in range(2)]
    assert same(learn.Suite(3, 8).fit(spark.createDataFrame(halves, SUITE), 0.5, most=300).w)
    doubled = [(i, [f for f in x for _ in range(2)], [0.5] * (2 * len(x)), c, w) for i, x, v, c, w in rows]
    assert same(learn.Suite(3, 8).fit(spark.createDataFrame(doubled, SUITE), 0.5, most=300).w)
    listed = [(i, [[f * 3 + c for f in x] for c in range(3)], [v] * 3, cost, w) for i, x, v, cost, w in rows]
    kind = SUITE.replace("ids array<bigint>, vals array<double>", "ids array<array<bigint>>, vals array<array<double>>")
    assert same(learn.Suite(3, 24, explicit=True).fit(spark.createDataFrame(listed, kind), 0.5, most=300).w)


def test_suite_gradient_with_costs():
    b = pd.DataFrame(suite_rows(noisy(6)), columns=["rid", "ids", "vals", "costs", "weight"])
    b["costs"] = [[0.0, 2.0, float("inf")], [1.0, 0.0, 3.0]] * 3
    b["weight"] = [1.0, 2.5, 1.0, 0.5, 1.0, 1.0]
    m, w = learn.Suite(3, 8), np.random.default_rng(2).normal(size=24)
    _, g = m.partial(b, w)
    for i in range(0, 24, 3):
        e = np.zeros(24)
        e[i] = 1e-5
        assert abs((m.partial(b, w + e)[0] - m.partial(b, w - e)[0]) / 2e-5 - g[i]) < 1e-4


def test_suite_options(spark):
    df = spark.createDataFrame(suite_rows(noisy()), SUITE)
    far = np.full(24, 0.3)
    near = learn.Suite(3, 8).fit(df, 1e4, init=far, mean=far)
    assert np.abs(near.w - far).max() < 0.01
    early = learn.Suite(3, 8).fit(df, 0.5, dpp=10.0)
    late = learn.Suite(3, 8).fit(df, 0.5, dpp=10.0, repeat=4)
    loss = lambda m: learn.summed(df.select("ids", "vals", "costs", "weight"), m.partial, m.w)[0] + 0.25 * float(m.w @ m.w)
    assert loss(late) < loss(early)
    best = learn.Suite(3, 8).fit(df, 0.5, dev=df)
    assert best.accuracy(df) >= learn.Suite(3, 8).fit(df, 0.5, dev=df, last=True).accuracy(df)


def test_held_out_report(spark):
    df, report = spark.createDataFrame(chains(), "seq string, ids array<array<bigint>>, gold array<bigint>"), []
    w, loss = learn.crf_fit(df, 2, 5, sigma=3.0, held_out=df, report=report)
    assert [k for k, _, _ in report] == list(range(1, len(report) + 1)) and abs(report[-1][1] - loss) < 1e-9
    assert all(0 <= a <= 1 for _, _, a in report) and report[-1][2] > 0.7


def test_model_files(spark, small):
    d, _ = small
    got = registry.queries()["model_files"](spark, d).collect()
    assert {r.kind for r in got} == {"maxent", "maxent answers", "labelled", "binary", "latent", "chain"} and all(r.off < 1e-12 for r in got)


def test_model_files_refuse_a_feature_twice(spark, tmp_path):
    from turnloom.sources import models

    (tmp_path / "m.txt").write_text("**BIAS**\t0.5 0.25\na\t1 2\na\t3 4\n")
    with pytest.raises(ValueError, match="twice"):
        models.load_maxent(spark, str(tmp_path / "m.txt"))


def test_files_of_rows(spark, tmp_path):
    from turnloom.sources import text_files

    spec = ["a train all", "b dev 1-2,5-end weight 0.25", ""]
    assert text_files.parsed_filespec(spec) == [("a", "train", "all", 1.0), ("b", "dev", "1-2,5-end", 0.25)]
    for bad in ("a", "a other all", "a train all heavy 2", "a train all weight"):
        with pytest.raises(ValueError):
            text_files.parsed_filespec([bad])
    left, right = (spark.createDataFrame(list(enumerate(x)), "pos int, value string") for x in (["a", " ", "b"], ["1", "2", "", ""]))
    assert [(r.left, r.right) for r in text_files.aligned(left, right).orderBy("pos").collect()] == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="differ in length"):
        text_files.aligned(left, right.limit(1)).collect()


def test_densities_and_slices():
    from turnloom.operators import grammar

    x = np.linspace(1e-6, 60, 400001)
    assert abs(np.trapezoid([np.exp(grammar.log_gamma_density(v, 2.5, 1.5)) for v in x[::40]], x[::40]) - 1) < 1e-3
    y = np.linspace(1e-6, 1 - 1e-6, 10001)
    assert abs(np.trapezoid([np.exp(grammar.log_beta_density(v, 2.0, 3.0)) for v in y], y) - 1) < 1e-4
    assert grammar.log_beta_density(1.5, 2, 2) == grammar.log_gamma_density(-1, 2, 2) == -np.inf
    rng, v, seen = np.random.default_rng(1), 0.5, []
    for _ in range(6000):
        v = grammar.slice_sample(lambda t: grammar.log_beta_density(t, 2.0, 3.0), v, 0.0, 1.0, 0.2, rng)
        seen.append(v)
    assert abs(np.mean(seen) - 0.4) < 0.02 and abs(np.var(seen) - 0.04) < 0.008


def test_annealed_chains(spark):
    q = registry.queries()
    rows = q["adaptor_annealed"](spark, "").collect()
    assert len(rows) == 16 and rows[0].heat == 4.0 and rows[7].heat == 1.0
    assert all(0 < r.discount < 1 and r.strength > 0 and 0 <= r.accepted <= 1 and r.log_p < 0 for r in rows)


def test_latent_fit_has_every_block(spark):
    """Weights by feature, hidden state and label tell labels apart that pairs of them cannot; gradients of every structure."""
    rng = np.random.default_rng(5)
    b = pd.DataFrame(noisy(12), columns=["rid", "split", "label", "ids"])
    for on in (learn.LATENT, ("hxy",), ("y", "hx", "hy"), ("h", "xy"), learn.PAIRED):
        w = rng.normal(size=sum(learn.latent_sizes(3, 2, 8, on)))
        _, g = learn.latent_partial(3, 2, on)(b, w)
        for i in range(len(w)):
            e = np.zeros(len(w))
            e[i] = 1e-5
            assert abs((learn.latent_partial(3, 2, on)(b, w + e)[0] - learn.latent_partial(3, 2, on)(b, w - e)[0]) / 2e-5 - g[i]) < 1e-4
    m = {f: rng.normal(size=s) for f, s in (("y", 3), ("h", 2), ("hy", (2, 3)), ("hx", (8, 2)), ("xy", (8, 3)), ("hxy", (8, 2, 3)))}
    w, total = np.concatenate([m[f].reshape(-1) for f in learn.LATENT]), 0.0
    for _, _, y, x in noisy(12):
        e = np.array([[sum(m["hx"][f, h] + m["xy"][f, c] + m["hxy"][f, h, c] for f in x) + m["y"][c] + m["h"][h] + m["hy"][h, c] for c in range(3)] for h in range(2)])
        total += np.log(np.exp(e).sum()) - np.log(np.exp(e[:, y]).sum())
    assert abs(learn.latent_partial(3, 2, learn.LATENT)(b, w)[0] - total) < 1e-9


def test_latent_fit_keeps_the_best_on_dev_and_tunes(spark, monkeypatch):
    rows = noisy(80)
    train, dev = (spark.createDataFrame([r for r in rows if (r[1] == "train") == t], KIND) for t in (True, False))
    ways = [learn.latent_fit(train, 3, 8, 2, 0.1, on=learn.LATENT, dev=dev)]
    monkeypatch.setattr(blocks, "ONE_TASK", 0)  # from the driver, a job a pass
    seen = []
    plain = learn.lbfgs
    monkeypatch.setattr(learn, "lbfgs", lambda f, w, watch=None, **k: plain(f, w, watch=lambda v, loss: (seen.append((v.copy(), loss, k)), watch(v, loss)), **k))
    w, loss = learn.latent_fit(train, 3, 8, 2, 0.1, on=learn.LATENT, dev=dev)
    right = lambda v: learn.latent_hits(3, 2, learn.LATENT)(learn.labelled(dev.toPandas()), v)[0]
    first = max(range(len(seen)), key=lambda k: (right(seen[k][0]), -k))
    assert np.allclose(ways[0][0], w, atol=1e-3) and abs(ways[0][1] - loss) < 1e-6
    assert np.array_equal(w, seen[first][0]) and loss == seen[first][1] and seen[0][2]["most"] == 1500
    ridge, v, _ = learn.latent_tuned(train, dev, 3, 8, 2, (50.0, 0.1), on=learn.LATENT, most=10)
    assert ridge in (50.0, 0.1) and right(v) == max(right(learn.latent_fit(train, 3, 8, 2, r, on=learn.LATENT, dev=dev, most=10)[0]) for r in (50.0, 0.1))


def test_latent_passes_in_parts_and_few_calls():
    """A fit's parts beside each other give the sums of one block, and end with it; long runs need no call of their own."""
    rng = np.random.default_rng(4)
    parts = [(blocks.sparse([[0, *np.flatnonzero(rng.random(60) < 0.1) + 1] for _ in range(700)]), rng.integers(0, 3, 700)) for _ in range(3)]
    core, hits = learn.latent_core(3, 2, learn.LATENT), learn.latent_hits(3, 2, learn.LATENT)
    w = rng.normal(size=sum(learn.latent_sizes(3, 2, 61, learn.LATENT)))
    one, own, held = blocks.Here(parts), blocks.Here(parts, cores=2, parts=2), blocks.Here(parts, cores=2)
    for v in (w, w / 2):
        share, (loss, g) = held.later(hits, v), own.summed(core, v)
        assert share() == one.counted(hits, v) and np.allclose(g, one.summed(core, v)[1], atol=1e-9) and abs(loss - one.summed(core, v)[0]) < 1e-6
    pids = [h.pid for x in (own, held) for helpers in x.helpers.values() for h in helpers]
    own.end(), held.end()
    assert len(pids) == 2 and not any(os.path.exists(f"/proc/{pid}") for pid in pids)
    x = one.blocks[0][0]
    assert x.by_feat.sizes.max() == 2100 and len(x.by_feat.spans) <= x.by_feat.LONG
    dense = np.zeros((x.n, 61))
    at, _ = x.by_row.flat()
    np.add.at(dense, (np.repeat(np.arange(x.n), x.by_row.sizes), x.feats[at]), 1)
    d = rng.normal(size=(x.n, 6))
    assert np.allclose(x.to_feats(d), dense.T @ d, atol=1e-9) and np.allclose(x.of_feats(dense.T @ d), dense @ (dense.T @ d), atol=1e-6)


def test_passes_over_blocks_send_what_they_touch(spark):
    """Packed rows give the same sums as rows, in any number of partitions, with rows of no feature and values."""
    df = spark.createDataFrame([*noisy(), (99, "train", 1, [])], KIND).select("label", "ids")
    w = np.random.default_rng(1).normal(size=24)
    own = blocks.Blocks(df, learn.labelled)
    for fan in (16, 2):
        loss, g = own.summed(learn.maxent_core(3), w, fan)
        want, h = learn.maxent_partial(3)(df.toPandas(), w)
        assert abs(loss - want) < 1e-9 and np.allclose(g, h)
    dense = np.zeros((3, 8))
    dense[0, [1, 5]], dense[2, 1] = (2.0, 3.0), 4.0
    x, m, d, g = blocks.sparse([np.array([5, 1]), np.array([]), np.array([1])], [[3.0, 2.0], [], [4.0]]), w.reshape(8, 3), np.arange(9.0).reshape(3, 3), np.ones((8, 3))
    x.push(d, g)
    assert np.allclose(x.scores(m), dense @ m) and np.allclose(g, 1 + dense.T @ d)


def test_dictionary_of_frequent_features(spark):
    from turnloom.operators import encode

    rng = np.random.default_rng(2)
    rows = [(i, 0, ("train", "dev")[int(rng.integers(2))], sorted({f"w{int(rng.integers(25))}" for _ in range(4)})) for i in range(40)]
    df = spark.createDataFrame(rows, "rid bigint, label int, split string, feats array<string>")
    want = encode.dictionary(encode.frequent_only(df, 6)).collect()
    assert sorted(encode.frequent_dictionary(df, 6).collect()) == sorted(want) and len(want) > 3


def test_the_optimiser_keeps_long_vectors_in_files(monkeypatch):
    """Steps and changes of gradients leave the driver's memory, with the same weights."""
    import tempfile

    a = np.random.default_rng(1).random((40, 12))
    f = lambda w: (float(np.logaddexp(0, a @ w).sum() + w @ w / 2), a.T @ (1 / (1 + np.exp(-(a @ w)))) + w)
    want, loss = optimise.lbfgs(f, np.ones(12), memory=3, eps=1e-9)
    made, plain = [], tempfile.TemporaryFile
    monkeypatch.setattr(optimise, "IN_FILES", 0)
    monkeypatch.setattr(tempfile, "TemporaryFile", lambda *a: made.append(plain(*a)) or made[-1])
    got, other = optimise.lbfgs(f, np.ones(12), memory=3, eps=1e-9)
    assert len(made) == 1 and np.array_equal(got, want) and loss == other


def test_a_large_gradient_reaches_the_driver_once(spark, monkeypatch):
    """Partitions that all touch a feature do not each send it to the driver."""
    from pyspark import RDD

    monkeypatch.setattr(blocks, "ONE_MODEL", 0)
    rows = [(k, k % 2, list(range(60))) for k in range(64)]
    df = spark.createDataFrame(rows, "rid bigint, label int, ids array<bigint>").repartition(4).select("label", "ids")
    own, sent, plain = blocks.Blocks(df, learn.labelled), [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.extend(plain(self)) or sent)
    w = np.random.default_rng(2).normal(size=120)
    loss, g = own.summed(learn.maxent_core(2), w)
    monkeypatch.undo()
    x, want = learn.summed(df, learn.maxent_partial(2), w)
    assert sum(len(v) for _, (_, _, v) in sent) == 120
    assert math.isclose(loss, x) and np.allclose(g, want)
    own.release()


def test_blocks_of_one_task_are_joined(spark):
    """A fit in one task goes over one block, which gives the sums of its parts, with and without values, and of sequences."""
    df = spark.createDataFrame([*noisy(), (99, "train", 1, [])], KIND).repartition(5)
    own = blocks.Blocks(df.select("label", "ids"), learn.labelled)
    assert own.rdd.count() > 1
    w = np.random.default_rng(1).normal(size=24)
    n, (loss, g) = blocks.fitted(lambda held: (len(held.blocks), held.summed(learn.maxent_core(3), w)), 24, own)
    want, h = learn.maxent_partial(3)(df.toPandas(), w)
    assert n == 1 and abs(loss - want) < 1e-9 and np.allclose(g, h)
    own.release()
    lists, m, d = [np.array([5, 1]), np.array([], int), np.array([1, 2, 5])], w[:8, None], np.arange(6.0)[:, None]
    ones, vals = [np.ones(len(x)) for x in lists], [np.array([3.0, 2.0]), np.array([]), np.array([1.0, 4.0, 5.0])]
    dense = np.zeros((6, 8))
    for k, (x, v) in enumerate(zip([*lists, *lists], [*ones, *vals], strict=True)):
        dense[k, x] = v
    for narrow in (False, True):
        x, g = blocks.joined([blocks.sparse(lists, ones, narrow), blocks.sparse(lists, vals, narrow)]), np.ones((8, 1))
        x.push(d, g)
        assert np.allclose(x.scores(m), dense @ m) and np.allclose(g, 1 + dense.T @ d)
    seqs = pd.DataFrame({"ids": [[[0, 1], [2]], [[1]], [[2], [0], []]], "gold": [[0, 1], [1], [1, 0, 0]]})
    v = np.random.default_rng(3).normal(size=3 * 2 + 4 + 4)
    parts = [learn.lined_up(seqs.iloc[:2]), learn.lined_up(seqs.iloc[2:])]
    loss = learn.crf_core(2, 3)(learn.joined_lines(parts), v, g := np.zeros(len(v)))
    want, h = learn.crf_partial(2, 3)(seqs, v)
    assert abs(loss - want) < 1e-9 and np.allclose(g, h)


def test_fits_of_the_suite_go_on_at_the_same_time(spark, monkeypatch):
    import threading

    from turnloom.plans import learning_queries

    together, plain = threading.Barrier(4), learning_queries._fitted
    monkeypatch.setattr(learning_queries, "_fitted", lambda *a: (together.wait(60), plain(*a))[1])
    got = {r.measure for r in registry.queries()["suite_train"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 6


def test_training_reads_the_texts_once(spark, monkeypatch):
    """Dictionary and rows come from instances that are written."""
    from turnloom.operators import encode
    from turnloom.plans import learning_queries

    read, plain = [], encode.packed
    monkeypatch.setattr(encode, "packed", lambda x, ids: (read.extend(x.inputFiles()), plain(x, ids))[1])
    rows, n = learning_queries._data(spark, "/root/testdata/sf0.001")
    assert rows.count() and n > 1 and read and not any("conversations" in x for x in read)


def test_rows_are_encoded_alike_by_lookup_and_join(spark, monkeypatch):
    """Rows of unknown features, of none and of a key that occurs twice too."""
    from turnloom.operators import encode

    rows = [(1, 0, "train", ["b", "a"]), (2, 1, "dev", ["c", "x"]), (3, 0, "train", []), (4, 2, "test", ["a"]), (4, 2, "test", ["c", "a"]), (5, 1, "dev", ["x"])]
    df = spark.createDataFrame(rows, "rid bigint, label int, split string, feats array<string>")
    ids = spark.createDataFrame([("**BIAS**", 0), ("a", 1), ("b", 2), ("c", 3)], "f string, id bigint")
    looked, n = encode.packed(df, ids)
    got = sorted((r.rid, r.split, r.label, r.ids) for r in looked.collect())
    assert n == 4 and got == [(1, "train", 0, [0, 1, 2]), (2, "dev", 1, [0, 3]), (3, "train", 0, [0]), (4, "test", 2, [0, 0, 1, 1, 3]), (5, "dev", 1, [0])]
    monkeypatch.setattr(encode, "LOOKED_UP", 3)
    joined, n = encode.packed(df, ids)
    assert n == 4 and got == sorted((r.rid, r.split, r.label, r.ids) for r in joined.collect())


def test_sequences_are_alike_by_lookup_and_join(spark, small, monkeypatch):
    from turnloom.operators import encode
    from turnloom.plans import learning_queries

    made = []
    for most in (encode.LOOKED_UP, 0):
        monkeypatch.setattr(encode, "LOOKED_UP", most)
        seqs, n = learning_queries._items(spark, small[0])
        made.append((n, sorted((r.seq, [sorted(x) for x in r.ids], r.gold) for r in seqs.collect())))
    assert made[0] == made[1] and made[0][0] == 8 and len(made[0][1]) == 12
