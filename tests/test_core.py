"""Goldens of functions, order, cleaning, formats, models and streams."""

import itertools

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import chain, cleaning, encode, evaluate, grammar, learn, lexicon, linear, mdl, optimise, order
from turnloom.sources import feature_text as T


def column(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("what?s up", "what's up"), ("i?m", "i? m"), ("they?re here?so", "they're here? so"), ("im “ok” café…", "i'm ok caf "), ("it’s", "it's")])
def test_repair(spark, text, want):
    assert column(spark, text, X.repair_characters) == want.replace("i? m", "i'm")


def test_char_subst_is_its_sql(spark, tmp_path):
    """Marks in a row, rules that overlap, words beside letters of other scripts, line ends."""
    import duckdb

    from turnloom.plans import registry

    rng = np.random.default_rng(7)
    parts = ["?", "? ", "??", "i? m", "im", "Im ", " im", "ü", "é", "’", "…", ". s", ". S ", "s", "t", "d", "re", "ll", "ve", " r", "a", " ", "\n", ".", "_", "1", "“", "\u0001", "😀"]
    texts = ["what?? no", "hi? my", "a. s. s b", "im im im", "?t?d?s", "x??", "???", "ends?\n", "im\n", "üim ü", "i?m", "", None] + ["".join(rng.choice(parts, int(rng.integers(1, 12)))) for _ in range(3000)]
    spark.createDataFrame([(k, 0, "user", x) for k, x in enumerate(texts)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = {(a, b): c for a, b, c in con.sql(registry.oracle_sql()["char_subst"]).fetchall()}
    got = {(r.dyad, r.pos): r.unit for r in registry.queries()["char_subst"](spark, str(tmp_path)).collect()}
    assert [(texts[int(k[0])], got[k], want[k]) for k in want if got[k] != want[k]][:5] == [] and len(got) == len(texts)


@pytest.mark.parametrize("text,want", [(",, a,b ,", "a,b"), (", ,", ""), ("a", "a")])
def test_strip_commas(spark, text, want):
    assert column(spark, text, X.strip_commas) == want


@pytest.mark.parametrize("tok,want", [("a,b", "a , b"), ("so...", "so ... "), ("1,000", "1,000"), (",,,", ","), ("x", "x"), ("....", "...")])
def test_fix_punct(spark, tok, want):
    assert column(spark, tok, X.fix_punct) == want


def test_triples(spark):
    assert column(spark, "a a a b b c_d a a a a", X.remove_triples) == "a a b b cd a a"
    assert column(spark, ["a", "a", "a"], X.has_triple, "array<string>") and not column(spark, ["a", "a", "b"], X.has_triple, "array<string>")


@pytest.mark.parametrize("n", [2, 3, 4])
def test_skip_grams(spark, n):
    toks, w = list("abcdef"), 3
    want = ["/".join(toks[i] for i in c) for c in itertools.combinations(range(6), n) if c[-1] - c[0] <= w]
    assert sorted(column(spark, toks, lambda c: X.skip_grams(c, n, w), "array<string>")) == sorted(want)


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("generalization", "gener"), ("sky", "sky"), ("controll", "control")])
def test_porter(word, stem):
    assert X.porter_stem(word) == stem


def test_first_seen_ids(spark):
    df = spark.createDataFrame(list(enumerate(["zero", "one", "two", "one", "three", "zero"])), "pos int, w string")
    assert {r.w: r.id for r in order.first_seen_ids(df, "w", "pos").collect()} == {"zero": 0, "one": 1, "two": 2, "three": 3}


def test_running_sum_and_runs(spark):
    df = spark.createDataFrame([("d", i, "aabba"[i]) for i in range(5)], "dyad string, pos bigint, role string")
    assert [r.c for r in order.running_sum(df, "pos", F.col("pos"), "c", block=2).orderBy("pos").collect()] == [0, 1, 3, 6, 10]
    assert [r.run for r in order.runs(df, "dyad", "pos", "role").orderBy("pos").collect()] == [1, 1, 2, 2, 3]


def test_greedy_split_like_the_loop(spark):
    sizes = [7, 1, 5, 3, 9, 2, 4, 6]
    df = spark.createDataFrame([(f"d{i}", n, f"{i:03}") for i, n in enumerate(sizes)], "doc string, n bigint, o string")
    got = {r.doc: r.split for r in order.greedy_split(df, (3, 1, 1)).collect()}
    docs, total, want = list(enumerate(sizes)), sum(sizes), {}
    for part, share in (("train", 0.6), ("dev", 0.2), ("test", 0.2)):
        left = share * total
        while docs and left > 0:
            i, n = docs.pop(0)
            want[f"d{i}"] = part
            left -= n
    assert {k: v for k, v in got.items() if v} == want


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows, 1)], "lineno bigint, value string")


def test_cleaning(spark):
    raw = lines(spark, "12,1,Grocery,hello there / IP how are you / QR", "bad", "12,2,wine,fine a-b thanks / SF", "12,3,we could trade / IDN", "13,1,no speaker / IP", "12,4,gro,one / two IP", "12,5,Grocery,first part is long / IP Wine,second part is long / SF")
    parsed = cleaning.parse_dyads(raw)
    spoken = cleaning.resolve_speakers(parsed)
    turns = cleaning.merged_turns(spoken)
    units = [(r.dyad, r.speaker, r.unit.strip(), r.code) for r in cleaning.aligned(turns).orderBy("dyad", "turn", "k").collect()]
    assert units[:4] == [("12", "Grocery", "hello there", "IP"), ("12", "Grocery", "how are you", "QR"), ("12", "Wine", "fine ab thanks", "SF"), ("12", "Wine", "we could trade", "IDN")]
    assert ("12", "Grocery", "first part is long", "IP") in units and ("12", "Wine", "second part is long", "SF") in units
    assert {(r.lineno, r.reason) for r in cleaning.rejects(parsed, spoken, turns).collect()} >= {(2, "m1"), (5, "m2")}


@pytest.mark.parametrize("text,want", [("x P!y ESbr", ["P1", "ESBR"]), ("PM IP", ["IP"]), ("PM QR", ["PM", "QR"]), ("PM", ["PM"]), ("IN N here", ["INN"]), ("WIPE", [])])
def test_codes(spark, text, want):
    got = column(spark, text, cleaning.codes_of)
    assert got == want


def test_formats(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("0 a b\nDEV\n1 c\nTEST\n2 d d\n")
    got = [(r.split, r.label, r.feats) for r in T.binary_rows(T.sections(T.numbered(spark, str(p)))).orderBy("pos").collect()]
    assert got == [("train", "0", ["a", "b"]), ("dev", "1", ["c"]), ("test", "2", ["d"])]
    items = spark.createDataFrame(list(enumerate(["IP\tF_w=a\tF_t\\:now:2.0", "SF\tx\\\\y\t# note", "", "QR\tz"], 1)), "pos bigint, value string")
    rows = [(r.seq, r.label, r.attr, r.scale) for r in T.crf_items(items).orderBy("pos", "attr").collect()]
    assert rows == [(0, "IP", "F_t:now", 2.0), (0, "IP", "F_w=a", 1.0), (0, "SF", "x\\y", 1.0), (1, "QR", "z", 1.0)]


def test_gzip_lines(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("x\ny\n")
    assert [(r.pos, r.value) for r in T.numbered(spark, str(tmp_path / "a.gz")).orderBy("pos").collect()] == [(1, "x"), (2, "y")]


def test_lexicon(spark):
    lex = spark.createDataFrame([("the", False, 1), ("an", True, 2), ("er", True, 3)], "word string, partial boolean, ord int")
    toks = spark.createDataFrame([("the",), ("banter",), ("xyz",), ("an",)], "tok string")
    assert {r.tok: r.ord for r in lexicon.tag_tokens(toks, lex).collect()} == {"the": 1, "banter": 3, "an": 2}
    assert {r.tok: r.ord for r in lexicon.tag_tokens(toks, lex, last=False).collect()}["banter"] == 2


def test_ties(spark):
    s = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.1)], "rid bigint, c int, score double")
    assert linear.best(s).first().pred == 0 and linear.ranked(s).first().kbest == [0, 1, 2]
    assert abs(sum(r.p for r in linear.softmax(s).collect()) - 1) < 1e-12


def test_quantile(spark):
    for p, z in ((0.5, 0.0), (0.975, 1.959964), (0.1, -1.281552)):
        assert abs(column(spark, p, linear.normal_quantile, "double") - z) < 1e-3


def test_accuracy_counts_unseen_tags(spark):
    rows = spark.createDataFrame([(0, [1, 0]), (0, [0, 1]), (2, [3, 1])], "ref bigint, kbest array<bigint>")
    assert {(r.tag, r.correct, r.total) for r in evaluate.accuracy(rows, 1).collect()} == {("0", 1, 2), ("1", 0, 0), ("2", 0, 1), ("3", 0, 0), ("Overall", 1, 3)}


def test_lattice_against_all_paths():
    rng = np.random.default_rng(5)
    lat = chain.Lattice(rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    s = rng.normal(size=(4, 3))
    paths = list(itertools.product(range(3), repeat=4))
    scores = np.array([lat.path_score(s, p) for p in paths])
    path, best = lat.viterbi(s)
    assert tuple(path) == paths[scores.argmax()] and abs(best - scores.max()) < 1e-9
    z = np.logaddexp.reduce(scores)
    assert abs(lat.log_norm(s) - z) < 1e-9
    want = np.array([[np.exp(scores[[p[t] == k for p in paths]] - z).sum() for k in range(3)] for t in range(4)])
    assert np.allclose(lat.marginals(s), want)


def gradient_is_right(f, w):
    _, g = f(w)
    for i in range(0, len(w), max(1, len(w) // 12)):
        e = np.zeros_like(w)
        e[i] = 1e-5
        assert abs((f(w + e)[0] - f(w - e)[0]) / 2e-5 - g[i]) < 1e-4


def test_gradients():
    import pandas as pd

    rng = np.random.default_rng(2)
    b = pd.DataFrame({"label": [0, 2, 1], "ids": [[0, 1], [0, 3], [0, 2, 4]]})
    gradient_is_right(lambda w: learn.maxent_partial(3)(b, w), rng.normal(size=15))
    gradient_is_right(lambda w: learn.latent_partial(3, 2)(b, w), rng.normal(size=3 + 2 + 6 + 5 * 5))
    seq = pd.DataFrame({"ids": [[[0], [1, 2], []], [[3]]], "gold": [[0, 1, 1], [1]]})
    gradient_is_right(lambda w: learn.crf_partial(2, 4)(seq, w), rng.normal(size=8 + 4 + 4))


def test_optimisers():
    x, loss = optimise.lbfgs(lambda w: (float(((w - 3) ** 2).sum()), 2 * (w - 3)), np.zeros(4))
    assert np.allclose(x, 3) and loss < 1e-8
    x, _ = optimise.lbfgs(lambda w: (float(((w - np.array([3.0, 0.1])) ** 2).sum()), 2 * (w - np.array([3.0, 0.1]))), np.zeros(2), l1=1.0)
    assert abs(x[0] - 2.5) < 1e-4 and x[1] == 0


def test_learning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "train", i % 2, [0, 1 + i % 2, 3 + int(rng.integers(3))]) for i in range(40)]
    df = spark.createDataFrame(rows, "rid bigint, split string, label int, ids array<bigint>").coalesce(2)
    assert learn.MaxEnt(2, 6).fit(df, 0.1, most=10).accuracy(df) == 1.0
    m = learn.perceptron(df, 6, 2, passes=3)
    assert all(m[ids].sum(0).argmax() == y for _, _, y, ids in rows)
    assert np.array_equal(learn.passive_aggressive(df, 6, 2, passes=1), learn.passive_aggressive(df, 6, 2, passes=1))


def test_phrases(spark):
    w = spark.createDataFrame([("d", i, x) for i, x in enumerate("new york is new york and new york".split() * 8)], "doc string, pos bigint, w string")
    assert [(r.a, r.b) for r in mdl.induce(w).where("round = 0").collect()] == [("new", "york")]
    assert "new_york" in {r.w for r in mdl.merge(w, spark.createDataFrame([("new", "york")], "a string, b string")).collect()}


def test_phrases_as_one_by_one(spark):
    """Rounds of best pairs give the segmentation of merges one by one."""
    from math import log2

    rng = np.random.default_rng(3)
    docs = {f"d{k}": [x for _ in range(40) for x in (["in", "spite", "of"] if rng.random() < 0.3 else [f"w{int(rng.zipf(1.6)) % 60}"])] + [f"once{k}a", f"once{k}b", f"once{k}c"] for k in range(4)}
    nl = lambda x: x * log2(x) if x > 0 else 0.0

    def best(state):
        n, pairs, first = Counter(w for d in state.values() for _, w in d), Counter(), {}
        for d, ws in sorted(state.items()):
            for (p, a), (_, b) in zip(ws, ws[1:]):
                if a != b:
                    pairs[a, b] += 1
                    first.setdefault((a, b), (d, p))
        o, found = sum(n.values()), []
        for (a, b), g in pairs.items():
            la, lb = len(a.split("_")), len(b.split("_"))
            size = la + lb + 1 if n[a] != g and n[b] != g else la if n[a] != g else lb if n[b] != g else -1
            bits = nl(n[a] - g) + nl(n[b] - g) + nl(g) - nl(o - g) + nl(o) - nl(n[a]) - nl(n[b]) - log2(len(n) + 1) * size
            found.append((-round(bits, 9), first[a, b], a, b))
        return min(found)

    state = {d: list(enumerate(ws)) for d, ws in docs.items()}
    want = []
    while (top := best(state))[0] < -5:
        _, _, a, b = top
        want.append((a, b))
        for d, ws in state.items():
            out, k = [], 0
            while k < len(ws):
                both = k + 1 < len(ws) and (ws[k][1], ws[k + 1][1]) == (a, b)
                out.append((ws[k][0], f"{a}_{b}" if both else ws[k][1]))
                k += 2 if both else 1
            state[d] = out
    w = spark.createDataFrame([(d, k, x) for d, ws in docs.items() for k, x in enumerate(ws)], "doc string, pos bigint, w string")
    assert len(want) > 8 and sorted((r.a, r.b) for r in mdl.induce(w).collect()) == sorted(want)


def test_induction_in_one_task_has_the_merges_of_jobs(spark, monkeypatch):
    """Also where a phrase is a word of some text already, and where two pairs give the same phrase."""
    rng = np.random.default_rng(4)
    kinds = ["q r", "q_r u", "q_r v", "q r u", "x_y z", "x y_z", "x_y z x y_z", "once", "p p p"]
    docs = {str(d): " ".join(rng.choice(kinds, 12)).replace("once", f"h{d} i{d} j{d}").split() for d in range(30)} | {"empty": []}
    w = spark.createDataFrame([(d, k, x) for d, ws in docs.items() for k, x in enumerate(ws)], "doc string, pos bigint, w string")
    ways = []
    for most in (mdl.ONE_TASK, -1):
        monkeypatch.setattr(mdl, "ONE_TASK", most)
        ways.append(sorted(mdl.induce(w, 0.0).collect()))
    assert len(ways[0]) > 30 and {"q_r"} <= {r.a for r in ways[0]} and ways[0][-1]["round"] > 0
    assert [r[:3] for r in ways[0]] == [r[:3] for r in ways[1]] and np.allclose([r.bits for r in ways[0]], [r.bits for r in ways[1]])


def test_inside_probabilities_sum_to_one():
    rules = grammar.normalised([(1, "S", "A A"), (1, "A", "a"), (3, "A", "b")])
    assert abs(sum(grammar.Chart(rules, w).inside("S", 0, 2) for w in itertools.product("ab", repeat=2)) - 1) < 1e-12
    trace, cache = grammar.gibbs(rules, "S", ["a b", "b b"], ("A",), 4, 1)
    assert len(trace) == 4 and sum(cache.tables["A"].values()) == 4


def test_dictionary_begins_with_the_bias(spark):
    x = spark.createDataFrame([(2, 0, "train", ["b", "c"]), (1, 1, "train", ["a"]), (3, 0, "test", ["z"])], "rid bigint, label int, split string, feats array<string>")
    ids = encode.dictionary(x)
    assert {r.f: r.id for r in ids.collect()} == {"**BIAS**": 0, "a": 1, "b": 2, "c": 3}
    assert {(r.rid, r.id) for r in encode.encode(x, ids).collect()} == {(1, 0), (1, 1), (2, 0), (2, 2), (2, 3), (3, 0)}


def test_stream_runs(spark, tmp_path):
    from turnloom.streaming.units import turn_runs, unit_stream

    rows = [(1, t, r, "What?s up,") for t, r in enumerate(["user", "user", "assistant", "user"])]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = turn_runs(unit_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.role, r.first_pos, r.n) for r in spark.table("runs").collect()) == [("assistant", 2, 1), ("user", 0, 2)]


def test_registry_has_sql_for_most():
    import __spark_entry__

    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(sql) > 100
