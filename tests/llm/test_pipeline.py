import zlib

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from rostra.llm import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_lines import brute as without_copies
from tests.llm.test_simhash import near_groups


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    dense, rows = model.dense(), []
    for i, t in texts.items():
        own = dense[toxicity.feature_ids(t.encode())].sum(dtype=np.float64) + model.bias
        if 1 / (1 + np.exp(-own)) < toxicity.REJECT_AT:
            rows.append((i, t))
    assert len(labels) and len(rows) > 0.8 * len(texts)
    rows = [(i, kept) for i, *_, kept in without_copies(rows)]
    rows.sort()
    top = near_groups([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if top[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i, _, _, _, is_bad in contaminated(rows, items) if is_bad}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: zlib.crc32(np.array(library.encode(t), "<u4").tobytes()) for i, t in rows if i not in bad}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and len(got) == len(want)
    assert all(r.lossless and zlib.crc32(r.ids) == r.ids_crc32 for r in got)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
