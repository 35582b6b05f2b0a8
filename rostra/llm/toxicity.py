"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are maximal runs of letters, digits and non-ASCII bytes, ASCII lower-cased. A document's features are the set of
its words, adjacent pairs and pairs with one word between, hashed to ``2**bits`` coordinates. Each coordinate has its own
learning rate (from its sum of squared gradients) and L1 keeps most at exactly zero, so the model that goes to the
executors is a short list of (coordinate, weight) pairs of at most ``2**bits`` entries, whatever the corpus.

Learning rate and L1 were chosen by choose(): three folds of the rows that labels may be learned from, by the mean logistic loss; no
held-out label takes part in it.

Null and empty texts have no features and get the intercept's score; very long texts are taken whole. With no labelled rows (an empty
table among them), or with one class only, every score is 0. Equal texts are scored alike; columns other than doc_id and text are not looked
at. Of examples with equal ranks the one with the smaller text checksum comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import bound_batches

BITS = 20
#: Bounds of the labelled sample that is fitted in one task, in rows and in features of all rows (documented parameters of train()).
MAX_TRAIN_ROWS, MAX_TRAIN_FEATURES = 16_384, 1 << 25
#: A document is rejected from this score on.
REJECT_AT = 0.7

_WORD_BYTES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_hashes(text: bytes) -> np.ndarray:
    """A 32-bit hash of each word, in order, as uint64."""
    words = text.lower().translate(_WORD_BYTES).split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def coordinates(text: bytes, bits: int = BITS) -> np.ndarray:
    """Coordinates of the text's words, pairs and skip-pairs, repeats included."""
    h = word_hashes(text)
    every = np.concatenate([h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + (h[2:] ^ _MIX)])
    every ^= every >> np.uint64(29)
    return ((every * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def feature_ids(text: bytes, bits: int = BITS) -> np.ndarray:
    """Distinct coordinates of the text."""
    return np.unique(coordinates(text, bits))


@dataclass(frozen=True)
class Weights:
    """Non-zero coordinates, their weights, and the intercept (None: nothing was learned)."""

    ids: np.ndarray
    values: np.ndarray
    bias: float | None
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.ids] = self.values
        return out


def fit(
    rows: Iterable[tuple[np.ndarray, int]],
    bits: int = BITS,
    epochs: int = 6,
    alpha: float = 8.0,
    beta: float = 1.0,
    l1: float = 10.0,
    l2: float = 1.0,
) -> Weights:
    """FTRL-proximal over (feature ids, 0/1) examples, in the given order in each epoch."""
    rows = list(rows)
    if len({y for _, y in rows}) < 2:
        return Weights(np.empty(0, np.int64), np.empty(0, np.float32), None, bits)
    size = 1 << bits
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    b = bias_n = 0.0
    for _ in range(epochs):
        for ids, y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[ids].sum() + b, -35, 35)))
            g = p - y
            old_n, old_w = n[ids], w[ids]
            new_n = old_n + g * g
            new_z = z[ids] + g - (np.sqrt(new_n) - np.sqrt(old_n)) / alpha * old_w
            n[ids], z[ids] = new_n, new_z
            w[ids] = -np.sign(new_z) * np.maximum(np.abs(new_z) - l1, 0) / ((beta + np.sqrt(new_n)) / alpha + l2)
            bias_n += g * g
            b -= alpha / (beta + np.sqrt(bias_n)) * g
    kept = np.flatnonzero(w)
    return Weights(kept, w[kept].astype(np.float32), float(b), bits)


def learnable(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 3 is not 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(rank, text, label) of at most ``rows`` learnable labelled documents, chosen and ordered by a hash of doc_id.

    Only the chosen ids (16 bytes each, at most ``rows``) are broadcast; no text outside the sample moves. Of several
    labels for one id the largest counts; null labels are no labels.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learnable(F.col("doc_id"))
    )
    chosen = (
        own.groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("rank", F.xxhash64("doc_id"))
        .orderBy("rank", "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("rank", "text", "label")


def _examples(docs: DataFrame, labels: DataFrame, label: str, rows: int, bits: int) -> DataFrame:
    """(rank, tie, features binary of little-endian 32-bit coordinates, label): features are taken where the texts are, so that no text moves."""
    bound_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([feature_ids(t, bits).astype("<i4").tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    own = labelled_sample(docs, labels, label, rows)
    return own.select("rank", F.crc32("text").alias("tie"), F.arrow_udf(run, "binary")("text").alias("features"), "label")


def _held(batches: Iterable[pa.RecordBatch], most: int) -> list[tuple[np.ndarray, int]]:
    """(feature ids, label) of the rows (rank, tie, features, label), in their order, until ``most`` features are held."""
    rows, size = [], 0
    for batch in batches:
        for features, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            size += len(features) // 4
            if rows and size > most:
                return rows
            rows.append((np.frombuffer(features, "<i4").astype(np.int64), y))
    return rows


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_TRAIN_FEATURES, **options) -> Weights:
    """Fit on at most ``max_rows`` labelled rows, and the first of them that have ``max_features`` features together, in one task; only the
    non-zero weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(_held(batches, max_features), **options)
        yield pa.RecordBatch.from_pydict(
            {"ids": [model.ids.astype("<i4").tobytes()], "weights": [model.values.astype("<f4").tobytes()], "bias": pa.array([model.bias], pa.float64())}
        )

    # One exchange to one task: the sample is bounded by max_rows, not by the corpus.
    sample = _examples(docs, labels, label, max_rows, options.get("bits", BITS)).repartition(1).sortWithinPartitions("rank", "tie")
    got = sample.mapInArrow(run, "ids binary, weights binary, bias double").first()
    if got is None:
        return fit([], **{k: v for k, v in options.items() if k == "bits"})
    return Weights(np.frombuffer(got.ids, "<i4").astype(np.int64), np.frombuffer(got.weights, "<f4"), got.bias, options.get("bits", BITS))


#: The settings that choose() weighs up.
SETTINGS = [{"alpha": a, "l1": l1} for a in (1.0, 2.0, 4.0, 8.0) for l1 in (3.0, 10.0, 30.0)]


def loss(model: Weights, rows: list[tuple[np.ndarray, int]]) -> float:
    """Mean logistic loss of (feature ids, label) rows."""
    dense = model.dense()
    margins = np.array([dense[ids].sum(dtype=np.float64) for ids, _ in rows]) + (model.bias or 0.0)
    return float(np.mean(np.logaddexp(0, -margins * np.where([y for _, y in rows], 1, -1)))) if rows else 0.0


def choose(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: list[dict] | None = None, folds: int = 3, max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_TRAIN_FEATURES) -> DataFrame:
    """(setting, loss) of each place in ``settings``, the best first: the mean logistic loss over the folds, each predicted by a model of the others.

    Folds deal the learnable rows by rank; held-out labels are never read. Each setting and fold is a task of its own over the bounded sample.
    """
    tried = SETTINGS if settings is None else settings
    sample = _examples(docs, labels, label, max_rows, BITS)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("tie", "ascending")])
        rows = _held(table.select(["rank", "tie", "features", "label"]).to_batches(), max_features)
        k, fold = table["setting"][0].as_py(), table["fold"][0].as_py()
        model = fit([r for j, r in enumerate(rows) if j % folds != fold], **tried[k])
        return pa.table({"setting": [k], "loss": [loss(model, rows[fold::folds])]}, schema=pa.schema([("setting", pa.int32()), ("loss", pa.float64())]))

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    jobs = sample.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(tried) * folds - 1))).alias("job"))
    jobs = jobs.select("*", F.floor(F.col("job") / folds).cast("int").alias("setting"), (F.col("job") % folds).alias("fold"))
    each = jobs.groupBy("setting", "fold").applyInArrow(run, "setting int, loss double")
    return each.groupBy("setting").agg(F.avg("loss").alias("loss")).orderBy("loss", "setting")


def scorer(model: Weights):
    """An Arrow UDF text -> score in 0..1."""

    def scores(texts: pa.Array) -> pa.Array:
        if model.bias is None:
            return pa.array(np.zeros(len(texts)))
        dense = scores.dense if hasattr(scores, "dense") else model.dense()
        scores.dense = dense
        sums = []
        for text in texts.cast(pa.binary()).to_pylist():
            ids = coordinates(text or b"", model.bits)
            sums.append(dense[np.unique(ids[dense[ids] != 0])].sum(dtype=np.float64))  # few coordinates have a weight
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64) + model.bias, -35, 35))))

    scores.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scores, "double")


def score(docs: DataFrame, model: Weights, column: str = "score") -> DataFrame:
    """docs with the toxicity score of each whole text in ``column`` (replaced where docs has one)."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(column, scorer(model)(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, **options) -> DataFrame:
    """docs, all columns, without the rows that score ``reject_at`` or more."""
    model = train(docs, labels, **options)
    return docs.where(scorer(model)(F.col("text")) < reject_at)
