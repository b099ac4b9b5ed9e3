"""Queries on tables where a cut of the input would show."""

from collections import Counter

import pytest

from turnloom.operators import chain
from turnloom.plans import learning_queries, model_queries, registry

WORDS = "one two three four five six seven one nine ten eleven two".split()


def tables(spark, path, rows):
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    rows = [(1, 0, "user", " ".join(WORDS)), (1, 1, "assistant", " ".join(reversed(WORDS))), (2, 0, "user", "short"), (3, 0, "system", "")]
    return rows, tables(spark, tmp_path_factory.mktemp("long"), rows)


def run(spark, name, d):
    return registry.queries()[name](spark, d).collect()


def test_every_word_is_an_attribute(spark, long_turns):
    rows, d = long_turns
    weight = model_queries._py_weight
    want = {(str(c), t, x): sum(weight(w, x) for w in set(text.split())) for c, t, _, text in rows for x in model_queries.LABELS}
    got = {(r.seq, r.t, r.label): r.s for r in run(spark, "crf_state_scores", d)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    states = Counter((w, role) for _, _, role, text in rows for w in set(text.split()))
    assert {(r.src, r.dst): r.freq for r in run(spark, "crf_features", d) if r.kind == "state"} == states
    heavy = {(w, x) for w in {*WORDS, "short"} for x in model_queries.LABELS if weight(w, x) > 0.5}
    assert {(r.f, r.label) for r in run(spark, "crf_model_compact", d)} == heavy
    s = [[want["1", t, x] for x in model_queries.LABELS] for t in (0, 1)]
    lat = model_queries.lattice()
    path, best = lat.viterbi(chain.np.array(s))
    found = {r.seq: r for r in run(spark, "crf_viterbi", d)}["1"]
    assert found.path == " ".join(model_queries.LABELS[k] for k in path) and abs(found.score - best) < 1e-5


def test_learners_have_every_word(spark, long_turns):
    rows, d = long_turns
    seqs, n = learning_queries._items(spark, d)
    assert n == len({*WORDS, "short"})
    per = {r.seq: [len(x) for x in r.ids] for r in seqs.collect()}
    assert per == {"1": [len(set(WORDS))] * 2, "2": [1], "3": [0]}


def test_scans_read_every_word(spark, long_turns):
    rows, d = long_turns
    want = Counter((str(c), t, w, k + 1.0) for c, t, _, text in rows for k, w in enumerate(text.split()))
    assert Counter((r.dyad, r.pos, r.attr, r.scale) for r in run(spark, "scan_crf_items", d)) == want
    got = {(r.dyad, r.pos, r["class"]): r.feats.split() for r in run(spark, "scan_explicit", d)}
    for c, t, _, text in rows[:3]:
        w = text.split()
        assert got[str(c), t, 0] == [*w[:3], "**BIAS**0**"] and got[str(c), t, 1] == [*w[3:], "**BIAS**1**"]


def test_learning_curve_has_all_sizes(spark, tmp_path):
    from hashlib import md5

    rows = [(c, t, "user", "some words") for c in range(700) for t in range(2)]
    d = tables(spark, tmp_path, rows)
    train = sorted((md5(str(r).encode()).hexdigest(), r) for r in (c * 2**32 + t for c, t, *_ in rows) if r % 10 < 6)
    sizes = [10 * 2**i for i in range(20) if 10 * 2**i < len(train)]
    assert sizes[-1] > 160
    assert sorted(map(tuple, run(spark, "learning_curve", d))) == [(n, n, sum(r % 1000003 for _, r in train[:n])) for n in sizes]


DE = "DE89370400440532013000"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"{DE} Thanks", [DE]), ("to DE89 3704 0044 0532 0130 00 5 euros", ["DE89 3704 0044 0532 0130 00"]), (f"{DE}X", [DE]), (f"AB12 CDEFGHIJKLM {DE}", [DE]),
        (f"{DE} GB82WEST12345698765432", [DE, "GB82WEST12345698765432"]), ("GB82 WEST 1234 5698 7654 32 NO93 8601 1117 947", ["GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]), ("DE88370400440532013000 Thanks", []),
    ],
)
def test_account_numbers_end_where_they_do(spark, text, want):
    pii = pytest.importorskip("turnloom.llm.pii")
    r = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [text[s.start : s.end] for s in r.iban] == want


def test_induction_goes_on_to_the_end(spark, tmp_path):
    from turnloom.operators import mdl

    pairs = [(f"a{k}", f"b{k}") for k in range(12)]
    d = tables(spark, tmp_path, [(c, 0, "user", " ".join(pairs[c % 12])) for c in range(12 * 40)])
    got = run(spark, "mdl_induct", d)
    assert sorted((r.a, r.b) for r in got) == sorted(pairs) and all(r.bits > 5 for r in got)
    left = spark.createDataFrame([(str(c), 1, "_".join(pairs[c % 12])) for c in range(12 * 40)], "doc string, pos bigint, w string")
    assert mdl.induce(left).count() == 0


def test_a_conversation_of_many_turns(spark, tmp_path):
    """Turns past the thousandth stay with their conversation, in keys, features, scans and sequences."""
    from turnloom.operators import encode

    rows = [(7, t, ("user", "assistant")[t % 2], f"w{t} x{t}") for t in range(1500)] + [(8, t, "user", f"z{t} y{t}") for t in range(600)]
    d = tables(spark, tmp_path, rows)
    x = encode.instances(spark, d)
    assert x.select("rid").distinct().count() == 2100
    want = {(str(c), t): set(text.split()) for c, t, _, text in rows}
    got = {}
    for r in run(spark, "scan_crf_items", d):
        got.setdefault((r.dyad, r.pos), set()).add(r.attr)
    assert got == want
    real = {}
    for r in run(spark, "scan_real_feats", d):
        real.setdefault((r.dyad, r.pos), set()).add(r.name)
    assert real == want
    assert Counter(r.split for r in run(spark, "scan_sections", d)) == Counter(r.split for r in x.collect())
    assert {(r.seq): len(r.path.split()) for r in run(spark, "crf_viterbi", d)} == {"7": 1500, "8": 600}
    ids = Counter(i for r in run(spark, "inverted_index", d) for i in r.rids.split())
    assert len(ids) == 2100 and set(ids.values()) == {3}
    (total,) = run(spark, "crf_eval_total", d)
    assert total is not None


def test_files_of_unequal_length_raise(spark, long_turns, monkeypatch):
    from turnloom.plans import data_queries

    _, d = long_turns
    whole = data_queries._two
    monkeypatch.setattr(data_queries, "_two", lambda spark, d: (whole(spark, d)[0], whole(spark, d)[1].limit(2)))
    with pytest.raises(Exception, match="differ in length"):
        run(spark, "append_feats", d)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """With both folders deleted the entry imports and lists the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 130, out.stderr
