import hashlib
from collections import defaultdict

from tests.llm.helpers import awkward, documents, multiset, words
from turnloom.llm import exact, mix


def test_exact_classes(spark):
    rows, groups = awkward(), defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = defaultdict(int)
    for r in rows:
        ids = [i for i in groups[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        want[r[0], keep, len(groups[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert multiset(exact.exact_classes(documents(spark)), *cols) == want
    assert multiset(exact.exact_classes(documents(spark), table_bytes=2000), *cols) == want  # most contents spill


def test_exact_empty(spark):
    assert exact.exact_classes(documents(spark, [])).count() == 0


def test_exact_stage(spark):
    out = exact.exact_dedup_stage(documents(spark)).collect()
    texts = [r.text or "" for r in out]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in awkward()})


def test_table_holds_contents_by_comparison():
    t = exact.ContentTable(10**6, 1)
    for k in range(3000):
        assert t.put(b"c%d" % (k % 1500), k, 1)
    assert len(t.contents) == 1500 and t.ids[t.contents.index(b"c7")] == 1507 and set(t.counts) == {2}


def fair_shares(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / max(free, 1) for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over - capped:
            return target
        capped |= over


def test_mixture(spark):
    rows = awkward() + [(1000 + k, f"w{k} " * (k % 40 + 1), "en", f"s{k % 3}", 1) for k in range(400)]
    got = mix.mixture(documents(spark, rows))
    sized, plan = got
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = fair_shares(sizes)
    p = {r.source: r for r in plan.collect()}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in sized.collect():
        n = p[r.source].copies + (r.hash < p[r.source].cut)
        assert 0 <= n <= 3 and r.size == len(words(next(x[1] for x in rows if x[0] == r.doc_id and x[3] == r.source and len(words(x[1])) == r.size)))
        taken[r.source] += n * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(p[s].target - target[s]) < 1e-5
        assert abs(taken[s] - target[s]) <= 2 * largest[s]


def test_mixture_empty_and_stage(spark):
    assert mix.mixture(documents(spark, []))[1].count() == 0
    docs = documents(spark)
    out = mix.mix_stage(docs)
    assert out.columns == docs.columns
    again = mix.mix_stage(docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_sources_without_words(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "b", 0)]
    assert {(r.target, r.copies, r.cut) for r in mix.mixture(documents(spark, rows))[1].collect()} == {(0.0, 0, 0)}
