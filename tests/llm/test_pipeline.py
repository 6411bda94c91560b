"""The pipeline against a brute-force run of its stages."""

from helpers import documents, sha

import corpus_pipeline
from quaymind.llm import bpe, mixing, quality, secrets, simhash
from quaymind.llm.common import DOC_COLUMNS, project


def test_stages_apply_one_after_the_other(spark, tmp_path):
    words = lambda a, n: " ".join(f"a{a}w{k}" for k in range(n))
    texts = [words(i, 40) for i in range(30)] + [words(3, 40)] * 3 + ["too short", None, words(50, 20) + " password=hunter2222"]
    sources = ["x" if i % 3 else "y" for i in range(len(texts))]
    project(documents(spark, texts, sources), DOC_COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [i for i, t in enumerate(texts) if t and len(t.split()) >= 10]
    kept = [i for i in kept if texts.index(texts[i]) == i]                       # copies: the first stays
    clean = {i: texts[i].replace("password=hunter2222", secrets.PLACEHOLDER) for i in kept}
    rows = [(i, sources[i], len(clean[i].split())) for i in kept]
    from test_sharding_mixing import plain_mix
    want = {}
    for d, size, _, _, taken in plain_mix(rows):
        want[d] = taken // size
    import public_tokenizers as P
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})
    expected = sorted((d, ",".join(map(str, enc.encode_ordinary(clean[d]))), sha(clean[d])) for d, n in want.items() for _ in range(n))
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in out) == expected


def test_all_but_the_last_stage_return_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (quality.clean_documents, simhash.one_per_class, secrets.redact_documents, mixing.mixed_documents):
        assert stage(docs).columns == docs.columns


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "source_mix", "token_ids"]
