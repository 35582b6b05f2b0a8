"""From documents to token ids in five stages, each a training-data operator applied to all its predecessor kept.

Each stage's result is written as Parquet to the shared folder and read again as the next one's input, so a lost
executor costs no more than the stage at hand. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rostra.llm import decontaminate, lines, pieces, simhash, staging, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among docs, scores below the limit."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs."""
    return lines.remove(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a similarity of 0.8 or more on 5-word shingles."""
    return simhash.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less of the benchmark than the limit."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's piece ids (binary, little-endian 32-bit) and what decoding them gives."""
    coded = pieces.digests(docs.select("doc_id", "lang", "source", "text"), MODEL, with_ids=True)
    return coded.select("doc_id", "lang", "source", "digest.*")


STAGES = [
    ("toxicity", toxic),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", contaminated),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The first stage is a trained model, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what a stage staged goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = staging.new_path(spark, f"stage{k}")
        since = staging.mark()
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        del out
        staging.release(since)
        staging.settle(spark)
    return docs
