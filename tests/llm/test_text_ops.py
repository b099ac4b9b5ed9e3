import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents, multiset, prose, words
from turnloom.llm import bpe, licenses, lines, ngram, pii, quality
from turnloom.llm.words import text_block

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
FULL = bpe.Codec(PATH, public_tokenizers.PATTERN)
TINY = bpe.Codec(PATH, public_tokenizers.PATTERN, chunk=16, overlap=5, threads=1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "'s", "'", "é", "1", "22", "!", "aaaaaaaaaaaaaaaaaaaa", "          ", "日本", "'ll", "　"]), max_size=60).map("".join))
def test_chunks_encode_like_the_library(text):
    ids = FULL.encoding.encode_ordinary(text)
    assert TINY.encode(text) == ids and TINY.decode(ids) == text.encode()
    assert FULL.encode(text * 40) == FULL.encoding.encode_ordinary(text * 40)


def test_bpe_rows(spark):
    rows = awkward() + [(60, " a'll \n\n 12 " * 9000, "en", "s", 1), (60, " a'll \n\n 12 " * 9000, "en", "s", 1)]
    out = bpe.token_digests(documents(spark, rows), PATH)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda r: FULL.encoding.encode_ordinary(r[1] or "")
    want = Counter((r[0], len(ids(r)), sha(" ".join(map(str, ids(r))).encode()), sha((r[1] or "").encode())) for r in rows)
    assert multiset(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode_ids(bpe.encode_ids(documents(spark), PATH), PATH)
    assert Counter((r.doc_id, bytes(r.content)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in awkward())
    assert bpe.token_digests(documents(spark, []), PATH).count() == 0


def test_library_reads_the_same_vocabulary():
    assert isinstance(FULL.encoding, tiktoken.Encoding) and len(FULL.bytes_of) == 50256


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


PII_TEXTS = [
    "", "mail a.b@c.de, x@y@z.com a@b.c_d@e.f.g abc@ x", "ip 1.2.3.4 256.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8 9.9.9.99999999999", "card 4539 5787 6362 1486 4111-1111-1111-1111 41111111111111112222 5",
    "call +1 (663) 555-6869 or +49 30 1234567 +1 2", "éé 日本 a@b.co 😀 +49(0)30.123.456.78 4111111111111111", "bank DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not DE88370400440532013000",
    "ssn 078-05-1120 plain 078-05-1121 far away", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a" * 50000 + "@" + "b." * 5000, "1" * 60000, "+1" + "(" * 50000, None,
]


def test_pii_base_spans(spark):
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(PII_TEXTS)])
    for r in pii.pii_spans(docs).collect():
        text = PII_TEXTS[r.doc_id] or ""
        for kind, pattern in BASE.items():
            want = [m.span() for m in re.finditer(pattern, text, re.A) if holds(kind, m[0])] if len(text) < 1000 else None
            if want is not None:
                assert [(s.start, s.end) for s in r[kind]] == want, (kind, text)
    by_id = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    assert len(by_id[6].iban) == 2 and len(by_id[7].ssn) == 1 and len(by_id[8].secret) == 1


def test_pii_account_numbers_and_boundaries(spark):
    texts = ["DE89370400440532013000 NOW", "DE89 3704 0044 0532 0130 00 BY FRIDAY", "xDE89370400440532013000", "SSN 123-45-6789, 987-65-4321", "ssn 1234-56-78901", 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "sum 9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1)]
    got = {}
    for r in pii.pii_spans(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append({k: [(s.start, s.end) for s in r[k]] for k in pii.KINDS})
    assert got[0][0]["iban"] == [(0, 22)] and got[1][0]["iban"] == [(0, 27)] and not got[2][0]["iban"]
    assert got[3][0]["ssn"] == [(4, 15), (17, 28)] and got[3][0] == got[3][1] and not got[4][0]["ssn"]
    assert got[5][0]["secret"] == [(9, 49)] and not got[6][0]["secret"]


def test_pii_scores_are_graded(spark):
    """More for a checksum, for a word of the kind close by, less for one far off, more for two."""
    card = "4111 1111 1111 1111"
    texts = [card, f"visa {card}", f"visa {'x' * 25} {card}", f"visa card {card}", f"{card} {'x' * 45} visa", "a@b.co"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    score = {r.doc_id: [s.score for k in pii.KINDS for s in r[k]] for r in pii.pii_spans(documents(spark, rows)).collect()}
    assert score == {0: [65], 1: [100], 2: [85], 3: [100], 4: [65], 5: [60]}
    far = documents(spark, [(1, f"card visa {'x' * 20} {card}", "en", "s", 1)])
    assert pii.pii_spans(far).first().card[0].score == 100
    assert pii.pii_spans(documents(spark, [])).count() == 0


def test_pii_mask(spark):
    docs = documents(spark, [(1, "to a@b.co from 1.2.3.4", "en", "s", 1), (2, None, None, None, None)])
    assert [r.text for r in pii.mask(docs).orderBy("doc_id").collect()] == ["to [EMAIL] from [IP]", None]


# quality


def counts(t):
    w = words(t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_counts(spark):
    rows = awkward() + [(70, "a b\na b\n\na b \n", "en", "s", 1), (71, "w1 w2 w3 w4 w5 w6 w7 w8 " * 5, "en", "s", 1), (72, "# $ | < >\r\nx\n", "en", "s", 1)]
    out = quality.judge(documents(spark, rows), quality.LineCrf())
    want = Counter()
    for r in rows:
        c = counts(r[1])
        want[(r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert multiset(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(r.kept == (not r.base_failed) for r in out.collect())  # without labels every line is content


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    crf = quality.LineCrf(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)))
    bounds = np.array([0, 0, 1, 5, 9, 9])
    feats = rng.integers(0, quality.FEATURES, (9, 8))
    got, score = crf.viterbi(feats, bounds), crf.state[feats].sum(1)
    for a, b in zip(bounds, bounds[1:], strict=False):
        paths = [[int(x) for x in np.binary_repr(k, b - a)] for k in range(2 ** (b - a))] if b > a else []
        if paths:
            value = lambda p, a=a: score[np.arange(a, a + len(p)), p].sum() + sum(crf.move[x, y] for x, y in zip(p, p[1:], strict=False))
            assert abs(value(list(got[a:b])) - max(map(value, paths))) < 1e-9


def test_crf_learns(spark):
    good = [(k, f"plain words {k} follow here\n" * 3 + "and more of them", "en", "s", 1) for k in range(30)]
    bad = [(100 + k, "BUY!! NOW!! ### $$$ %%%\nCHEAP!! ### ***", "en", "s", 1) for k in range(30)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (5000, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, good + bad)
    share = {r.doc_id: r.content_share for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert all(share[r[0]] > 0.9 for r in good) and all(share[r[0]] < 0.1 for r in bad)


def plain_features(t):
    """Feature indices of each line with a word, by plain string work."""
    cut = lambda bins, x: sum(x >= b for b in bins)
    out, seen = [], set()
    for line in (t or "").split("\n"):
        w = words(line)
        if not w:
            continue
        raw = line.encode()
        letters = sum(c.isascii() and c.isalpha() for c in line)
        common = max(Counter(w).values())
        shares = [
            sum(c in "#*$%&|<>" for c in line) / max(len(raw), 1), sum("A" <= c <= "Z" for c in line) / max(letters, 1), sum(x[-1] in "#*$%&|<>!" for x in w) / len(w),
            sum(x == "|" for x in w) / len(w), common / len(w) if len(w) > 5 else 0,
        ]
        width = len(quality.BINS) + 1
        at = [cut(quality.BINS, x) + k * width for k, x in enumerate(shares)]
        at += [cut(quality.LENGTHS, len(w)) + 5 * width, (line in seen) + 5 * width + len(quality.LENGTHS) + 1, quality.FEATURES - 1]
        seen.add(line)
        out.append((at, len(w)))
    return out


def plain_verdict(t, crf):
    """The verdict by counts, then by the best of all label paths."""
    c, items = counts(t), plain_features(t)
    if c[0] < 20 or 100 * c[4] > 30 * c[0]:
        return False
    best = [(0.0, ())]
    for at, _ in items:  # every path, cut down to the best one to each label
        s = crf.state[at].sum(0)
        best = [max(((v + s[y] + (crf.move[p[-1], y] if p else 0), (*p, y)) for v, p in best), key=lambda x: x[0]) for y in (0, 1)]
    path = max(best, key=lambda x: x[0])[1]
    return sum(n for (_, n), y in zip(items, path, strict=True) if y == 0) >= 0.5 * c[0]


JUNK = "BUY!! NOW!! ### $$$ %%% CHEAP!! ***"
GOOD = "plain words follow here and some more of them to read"


def mixed_corpus():
    good = [(k, "\n".join([f"{GOOD} {k}"] * (1 + k % 3)) + f"\nand {k} the last of it", "en", "s", 1) for k in range(30)]
    bad = [(100 + k, "\n".join([f"{GOOD} {k}"] * (k % 2) + [f"{JUNK} {k}{j}" for j in range(2 + k % 4)]), "en", "s", 1) for k in range(30)]
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    return good, bad, labels


def test_verdicts_by_brute_force(spark):
    good, bad, labels = mixed_corpus()
    sandwich = "\n".join([f"{JUNK} a{j}" for j in range(4)] + [f"{GOOD} m{j}" for j in range(6)] + [f"{JUNK} z{j}" for j in range(4)])
    rows = awkward() + good + bad + [(300, sandwich, "en", "s", 1), (301, "\n".join(f"{JUNK if k % 3 else GOOD} {k}" for k in range(4000)), "en", "s", 1), (300, sandwich, "en", "s", 1)]
    docs = documents(spark, rows)
    crf = quality.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = Counter((r.doc_id, r.kept) for r in quality.judge(docs, crf).collect())
    assert got == Counter((r[0], plain_verdict(r[1], crf)) for r in rows)
    lines_of = quality.Lines(text_block(sandwich.encode()))
    assert crf.viterbi(lines_of.features(), lines_of.bounds).tolist() == [1] * 4 + [0] * 6 + [1] * 4


def test_quality_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, [])
    assert quality.judge(docs, quality.train(docs, labels)).count() == 0
    assert quality.quality_stage(docs, labels).count() == 0 and quality.quality_stage(docs, labels).columns == docs.columns


# scores


def test_scores(spark):
    rows = awkward() + [(200 + k, " ".join(f"t{(k * j) % 11}" for j in range(30)), "en", "s", 1) for k in range(40)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = [[w.encode().lower() for w in words(r[1])] + ["end"] for r in rows]
    c = Counter(w for r, t in zip(rows, toks, strict=True) if not held(r[0]) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for r, t in zip(rows, toks, strict=True))
    out = ngram.score_documents(documents(spark, rows)).withColumn("b", F.round("base_score", 5)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.b) for r in out) == want
    assert all(r.score < 0 for r in out)


def phrases(n, seed):
    """Texts of a small grammar: words of a few kinds follow one another, and rare words are of a kind too."""
    rng = np.random.default_rng(seed)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "anvd"]
    word = lambda k: kinds[k][int(rng.integers(12))] if rng.random() < 0.9 else f"{'anvd'[k]}rare{int(rng.integers(400))}"
    return [(k, " ".join(word(i % 4) for i in range(4 * int(rng.integers(2, 20)))), "en", "s", 1) for k in range(n)]


def test_scores_by_brute_force(spark):
    rows = phrases(300, 4) + awkward()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    docs, most = documents(spark, rows), 40
    every = ngram._documents(docs)
    m = ngram.Model(every.where(~F.col("held_out")).select("text"), most)
    toks = [[w.encode().lower() for w in words(r[1])] for r in rows]
    key = lambda w: int(text_block(w).word_hashes()[0][0])
    place = {int(h): int(c) for h, c in zip(m.words, m.classes, strict=False)}
    others = {r.word % (1 << 64): r["class"] for r in m.known.collect()}
    train = [t for r, t in zip(rows, toks, strict=True) if not held(r[0])]
    n = Counter(w for t in train for w in t)
    assert 0 < len(place) <= most and len(place) + len(others) == len(n)
    own = {w: place.get(key(w), others.get(key(w))) for w in n}
    history = lambda w: ngram.BEGIN if w is None else place.get(key(w), ngram.OTHER)
    moves, size, kinds, once = Counter(), Counter(), Counter(own.values()), Counter(own[w] for w in n if n[w] == 1 and key(w) not in place)
    for t in train:
        for a, b in zip([None, *t], [*t, None], strict=True):
            moves[history(a), ngram.END if b is None else own[b]] += 1
    for w in n:
        size[own[w]] += n[w]
    unseen = max(range(ngram.CLASSES), key=lambda c: (once[c], -c))
    kinds[unseen] += 1
    to = [*range(ngram.CLASSES), ngram.END]
    out_of = {h: sum(moves[h, c] for c in to) for h in range(ngram.K)}
    step = lambda h, c: log10((moves[h, c] + 0.1) / (out_of[h] + 0.1 * len(to)))
    emit = lambda w: log10((n[w] + 0.1) / (size[own.get(w, unseen)] + 0.1 * kinds[own.get(w, unseen)]))
    score = lambda t: sum(step(history(a), own.get(b, unseen)) + emit(b) for a, b in zip([None, *t], t, strict=False)) + step(history(t[-1] if t else None), ngram.END)
    out = ngram.score_documents(docs, most).withColumn("s", F.round("score", 5)).collect()
    assert Counter((r.doc_id, r.s) for r in out) == Counter((r[0], round(score(t), 5)) for r, t in zip(rows, toks, strict=True))
    for h in range(ngram.K):  # words of all classes, the unseen one and the end are the whole of what may follow
        if h != ngram.END:
            mass = 10 ** step(h, ngram.END) + sum(10 ** (step(h, own[w]) + emit(w)) for w in n) + 10 ** (step(h, unseen) + log10(0.1 / (size[unseen] + 0.1 * kinds[unseen])))
            empty = sum(10 ** step(h, c) for c in range(ngram.CLASSES) if not kinds[c])
            assert abs(mass + empty - 1) < 1e-9


def test_held_out_texts_score_above_the_base(spark):
    docs = documents(spark, phrases(600, 5))
    history = ngram.Model(docs.select("text")).history
    assert all(b > a for a, b in zip(history, history[1:], strict=False)) and len(history) > 2
    out = [r for r in ngram.score_documents(docs).collect() if r.held_out]
    assert len(out) > 30 and sum(r.score for r in out) > sum(r.base_score for r in out) + 20


def test_exchange_parts_alternating_words():
    after, before = np.zeros((2, ngram.K)), np.zeros((2, ngram.K))
    after[0, 1] = before[0, 1] = 50  # unit 0 stands between class 1
    after[1, 0] = before[1, 0] = 50
    pairs = np.zeros((ngram.K, ngram.K))
    pairs[0, 1] = pairs[1, 0] = 500
    assert ngram.exchange(after, before, np.array([1, 0]), pairs).tolist() == [0, 1]


def test_scores_without_training(spark):
    assert ngram.score_documents(documents(spark, [])).count() == 0


# lines


def test_lines(spark):
    rows = [
        (1, "common footer line of the site\nunique one here for sure", "en", "s", 1), (2, "common footer line of the site\nanother body text is here", "en", "s", 1), (3, "Order 17 shipped to you today\nx", "en", "s", 1),
        (4, "Order 99 shipped to you today\nx", "en", "s", 1), (5, None, None, None, None), (None, "common footer line of the site", "en", "s", 1), (2, "common footer line of the site\nanother body text is here", "en", "s", 1), (6, "", "en", "s", 1),
    ]
    out = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(documents(spark, rows)).collect())
    assert out == Counter(
        [
            (1, 2, 0, rows[0][1]), (2, 2, 1, "another body text is here"), (2, 2, 1, "another body text is here"), (3, 2, 0, rows[2][1]), (4, 2, 1, "x"), (5, 1, 0, ""), (None, 1, 1, ""), (6, 1, 0, ""),
        ]
    )
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_fields_stay_fields_at_every_size(spark):
    """One template with two word-valued fields, beside lines of its leaf that are not its own."""
    name = lambda k: "n" + "".join("abcdefghij"[int(c)] for c in str(k))
    for n, values in ((20, 2000), (600, 30), (600, 2000)):
        rows = [(k, f"Your order placed by {name(k * 7919 % values)} was sent to {name(k * 104729 % values)} this week", "en", "s", 1) for k in range(n)]
        rows += [(n + k, "Your order placed " + " ".join(name(1000 * k + 10000 * j) for j in range(9)), "en", "s", 1) for k in range(5)]
        out = {r.doc_id: r.n_dropped for r in lines.dedup_lines(documents(spark, rows)).collect()}
        assert sum(out[k] for k in range(n)) >= 0.9 * (n - min(n, 30)) and not any(out[n + k] for k in range(5))


def test_long_text_of_lines(spark):
    body = "\n".join(f"line with number {k} of a long report about nothing" for k in range(3000))
    plain = "\n".join("alpha beta gamma " + " ".join(sorted({chr(97 + k % 26) * (j % 9 + 1 + k // 26 % 5) for j in range(8)})) for k in range(300))
    rows = [(1, body, "en", "s", 1), (2, body + "\ntail words that are only here", "en", "s", 1), (3, plain, "en", "s", 1)]
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert out[1] == (3000, 0, body) and out[2] == (3001, 3000, "tail words that are only here") and out[3] == (300, 0, plain)


# licenses


def test_licenses(spark):
    rows = [(k, f"body text\n{t}\nmore", "en", "s", 1) for k, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(100, "Released under MIT License", "en", "s", 1), (101, "nothing of the kind is said under this text", "en", "s", 1), (102, None, None, None, None), (103, "", "en", "s", 1), (104, licenses.TEMPLATES["mit"].replace(". ", ".\n"), "en", "s", 1)]
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, rows)).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert got[k].best_license == name and got[k].best_dice == 1.0
    assert got[101].licenses == got[102].licenses == got[103].licenses == "" and got[104].best_license == "mit"


def test_licenses_inside_other_text(spark):
    """One block, comment marks, edits and code around; prose, long texts, repeats and ties."""
    mit, header = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-header"].split()
    comment = "\n".join(f" * {' '.join(header[k : k + 9])}" for k in range(0, len(header), 9))
    gpl = licenses.TEMPLATES["gpl-3.0"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 17)
    long = prose(3, 20000)
    rows = [
        (1, "MIT License Copyright (c) 2020 Someone " + " ".join(mit.split()), "en", "s", 1), (2, f"/*\n{comment}\n */\npackage a;\nimport b.c;\nclass D {{}}\n", "en", "s", 1),
        (3, long, "en", "s", 1), (4, f"{long} {edited} {long}", "en", "s", 1), (4, f"{long} {edited} {long}", "en", "s", 1), (5, gpl, "en", "s", 1),
        (6, "the software is released under terms that nobody has read, without warranty of any kind in the license", "en", "s", 1), (7, "All rights reserved. all RIGHTS reserved", "en", "s", 1), (None, "One. word", "en", "s", 1),
    ]
    got = {}
    for r in licenses.license_scan(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.licenses, r.best_license, r.best_dice))
    assert got[1] == [("mit", "mit", 1.0)] and got[2] == [("apache-2.0-header,apache-2.0-notice", "apache-2.0-header", 1.0)]
    assert got[3] == got[6] == got[None] == [("", None, None)]
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0][1] == "mit" and got[4][0][2] > 0.8
    assert got[5][0][1:] == ("gpl-3.0", 1.0) and got[7][0][1] == "all-rights-reserved"
    assert licenses.license_scan(documents(spark, [])).count() == 0
    twice = {"b": "word one and word two of it", "a": "word one and word two of it"}
    (r,) = licenses.license_scan(documents(spark, [(1, "x word one and word two of it y", "en", "s", 1)]), twice).collect()
    assert (r.licenses, r.best_license, r.best_dice) == ("a,b", "a", 1.0)


def test_anchors_miss_no_window():
    """Any window of dice THETA or more has an anchor in it."""
    rng = np.random.default_rng(9)
    for t in licenses.prepared({k: licenses.TEMPLATES[k] for k in ("mit", "isc", "gpl-3.0-header", "mit-notice")}):
        anchors = {p for p, _ in t.anchors}
        for _ in range(300):
            w = [x if rng.random() > 0.15 else f"q{rng.integers(99)}" for x in t.words]
            mine = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
            if 2 * len(mine & set(t.bigrams)) / (len(mine) + len(t.bigrams)) >= licenses.THETA:
                assert mine & anchors and t.least <= len(mine) <= t.most
