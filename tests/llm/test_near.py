import numpy as np
import pytest

from tests.llm.helpers import awkward, documents, multiset, prose, shingles
from turnloom.llm import near
from turnloom.llm.words import text_block


def brute(rows):
    """Components over rows; equal sets are linked, rows with the same id are rows of their own."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), smallest.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def check(spark, rows):
    got = multiset(near.near_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    want = {}
    for d, n, c in brute(rows):
        want[d, n, c, d == c] = want.get((d, n, c, d == c), 0) + 1
    assert got == want


def test_awkward_rows(spark):
    check(spark, awkward())


def test_chain_without_a_common_head(spark):
    base = prose(3, 200).split()
    rows = [(100 - k, " ".join(base[: 200 - 9 * k] + [f"n{k}x{i}" for i in range(9 * k)]), "en", "s", 1) for k in range(10)]
    check(spark, rows)


def test_group_of_near_copies(spark):
    base = prose(4, 120).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[(k * 37) % 120] = f"v{k}"
        w[(k * 53) % 120] = f"u{k}"
        rows.append((k, " ".join(w), "en", "s", 1))
    check(spark, rows)


def test_empty_table(spark):
    assert near.near_components(documents(spark, [])).count() == 0


def test_stage_keeps_one_of_each(spark):
    out = near.near_dedup_stage(documents(spark))
    assert out.columns == documents(spark).columns
    want = {(d, c) for d, n, c in brute(awkward()) if d == c}
    assert {(r.doc_id, r.doc_id) for r in out.collect()} == want


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 40000).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        k = int(20000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:20000]), np.unique(pool[20000 - k : 40000 - k])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        e = near.estimate(near.sketch(a)[None], near.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(e[0] - true) < 0.15


def test_links_on_the_edge():
    a = set(range(100))
    assert near.linked(a, set(range(75))) and not near.linked(a, set(range(74)))


def test_group_of_half_likes(spark):
    """Members 0.6 to 0.8 alike to one another around a text that is not there."""
    base = [f"b{i}" for i in range(150)]
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        w = list(base)
        for j in range(1 + k % 5):
            w[int(rng.integers(150))] = f"v{k}x{j}" if k % 3 else f"shared{int(rng.integers(4))}"
        rows.append((k, " ".join(w), "en", "s", 1))
    check(spark, rows)


def thue_morse(n):
    out = "a"
    for _ in range(n):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_of_structure_have_their_own_fingerprints(spark):
    for n in range(4, 13):
        one = thue_morse(n)
        two = one.translate(str.maketrans("ab", "ba"))
        h = text_block(f"{one} {two} x{one}".encode()).word_hashes()[0]
        assert len(set(h.tolist())) == 3
    one = thue_morse(10)
    check(spark, [(1, f"{one} p q r s t", "en", "s", 1), (2, one.translate(str.maketrans("ab", "ba")) + " p q r s t", "en", "s", 1), (3, one, "en", "s", 1), (4, one.translate(str.maketrans("ab", "ba")), "en", "s", 1)])


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a", 1)])
def test_set_sizes(text, n):
    assert len(next(near.shingle_sets(text_block(text.encode())))) == n
