"""Each stage against a plain version of its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.helpers import awkward, documents, prose
from tests.llm.test_near import brute
from turnloom.llm import mix, quality
from turnloom.llm.bpe import Codec


def test_stages(spark, tmp_path):
    import public_tokenizers

    rows = awkward() + [(300 + k, "BUY!! NOW!! ### $$$ %%% " * 8 + f"v{k}", "en", "s1", 1) for k in range(12)] + [(400 + k, prose(k + 20, 90), "en", f"s{k % 2}", 1) for k in range(12)]
    rows += [(500, prose(25, 90), "en", "s0", 1), (501, prose(25, 90) + " tail", "en", "s0", 1)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(300 + k, 0, 0) for k in range(12)] + [(400 + k, 1, 0) for k in range(12)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        docs.persist()
        seen.append(docs)
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        assert len(seen) == 5 or docs.columns == seen[0].columns
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    raw, good, unique, near, mixed = map(pairs, seen)
    crf = quality.train(seen[0], labels)
    kept = {r.doc_id for r in quality.judge(seen[0].where("doc_id is not null"), crf).where("kept").collect()}
    assert {d for d, _ in good if d is not None} == kept and not {300 + k for k in range(12)} & kept and {400 + k for k in range(12)} <= kept
    by_text = {}
    for d, t in good:
        by_text.setdefault(t or "", []).append(d)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    assert unique == Counter((best(ids), t) for t, ids in by_text.items())
    assert near == Counter(u for u, (d, _, c) in zip(unique, brute(list(unique)), strict=True) if d == c)
    plan = {r.source: r for r in mix.mixture(seen[3])[1].collect()}
    want = Counter()
    for r in mix.mixture(seen[3])[0].collect():
        want[r.doc_id] += plan[r.source].copies + (r.hash < plan[r.source].cut)
    assert Counter(d for d, t in mixed.elements()) == +want
    codec = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.n_tokens) for r in docs.collect()) == Counter((d, len(codec.encode(t or ""))) for d, t in mixed.elements())
    assert raw and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_stage_is_the_verdict(spark, tmp_path):
    """The stage keeps the rows of the query's verdict, by the plain version of both."""
    from tests.llm.test_text_ops import mixed_corpus, plain_verdict

    good, bad, labels = mixed_corpus()
    rows = awkward() + good + bad
    docs, table = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    crf = quality.train(docs, table)
    want = Counter((r[0], r[1]) for r in rows if plain_verdict(r[1], crf))
    assert Counter((r.doc_id, r.text) for r in quality.quality_stage(docs, table).collect()) == want
