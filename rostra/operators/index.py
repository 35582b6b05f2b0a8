"""The keyword index and its upkeep: postings, corpus statistics, digests, the plan of what to index anew."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rostra.functions import text as T
from rostra.plans.size import BROADCAST_ROWS, held, is_small

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Stats:
    """Number of chunks and their mean length in tokens."""

    n: int
    avg_len: float


def with_tokens(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, terms, dl): each chunk's tokens and their number."""
    return chunks.select(key, T.tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))


def stats(chunks: DataFrame, key: str, text: str = "text") -> Stats:
    row = with_tokens(chunks, key, text).agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    return Stats(row.n, float(row.avg or 0.0))


def _bound(value: Column, body) -> Column:
    """body(value), value being computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of the distinct terms of an array, by runs of equal terms in sorted order."""

    def runs(own: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        ends = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(own))
        return _bound(begins, lambda s: F.transform(s, lambda b, k: F.struct(F.get(own, b).alias("term"), (ends(s, k) - b).cast("long").alias("tf"))))

    return F.when(F.size(terms) > 0, _bound(F.sort_array(terms), runs))


def postings(chunks: DataFrame, key: str, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, dl) of chunks with one row a key; with ``terms`` (column term), only theirs.

    Terms are counted within a chunk's row, so nothing is shuffled.
    """
    each = with_tokens(chunks, key, text).select(key, "dl", F.inline(term_counts(F.col("terms"))))
    each = each if terms is None else each.join(terms, "term")
    return each.select("term", key, "tf", "dl")


def frequencies(chunks: DataFrame, key: str, terms: DataFrame, text: str = "text") -> tuple[Stats, DataFrame]:
    """The corpus statistics and (term, df) of the terms (column term, distinct), both by one pass over the texts.

    Every chunk also counts for the empty term, which no text has: its row holds their number and lengths.
    """
    if not is_small(terms):
        return stats(chunks, key, text), term_stats(postings(chunks, key, text, terms)).select("term", "df")
    sought = F.broadcast(terms.select("term").union(chunks.sparkSession.createDataFrame([("",)], "term string")))
    each = with_tokens(chunks, key, text).select("dl", F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term"))
    counts = held(each.join(sought, "term").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length")), BROADCAST_ROWS + 1)
    row = counts.where("term = ''").first()
    return (Stats(row.df, row.length / row.df) if row else Stats(0, 0.0)), counts.where("term <> ''").select("term", "df")


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, df, cf): chunks a term is in and its occurrences."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def weight(tf: Column, dl: Column, avg_len: float, k1: float = K1, b: float = B) -> Column:
    """A document's weight of a term."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(float(avg_len))))


def sparse_vectors(chunks: DataFrame, key: str, avg_len: float, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, vector map<int,double>): weights by hashed term; weights of terms that share an index add up."""
    own = postings(chunks, key, text).select(key, T.term_index(F.col("term")).alias("i"), weight(F.col("tf"), F.col("dl"), avg_len, k1, b).alias("w"))
    return own.groupBy(key, "i").agg(F.sum("w").alias("w")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("vector"))


def idf(n: int, df: Column) -> Column:
    return F.ln(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def digest(parts: list[Column], group: list[str], df: DataFrame, order: list[str]) -> DataFrame:
    """(group..., digest): the first 16 hex digits of the SHA-256 of the group's parts, line by line in order (equal places by the parts).

    A group's lines are sorted on disk if need be and hashed as they come, so a large group costs time, not memory.
    """
    lines = df.select(*group, F.struct(*order).alias("__o"), F.concat_ws("\t", *parts).alias("__v"))
    lines = lines.repartition(*group).sortWithinPartitions(*group, "__o", "__v").select(*group, "__v")
    fields = [lines.schema[g] for g in group]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*own, state.hexdigest()[:16]], [*kinds, pa.string()], strict=True)], names=[*group, "digest"])

        for batch in batches:
            for *key, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != own:
                    if own is not None:
                        yield closed()
                    own, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n")
                    state.update(line.encode())
        if own is not None:
            yield closed()

    return lines.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "digest string"]))


def plan(current: DataFrame, state: DataFrame, stored: DataFrame, key: str = "doc_id", metadata_only: bool = False) -> DataFrame:
    """(key, action) of each document of ``current`` (key, text_digest, meta_digest, n_chunks).

    embed: no state (key, text_digest, meta_digest), another text, or another number of stored chunks (key, n_stored) than expected;
    metadata: only the metadata differ (a state without a metadata digest, as older ones are, counts as differing); skip: nothing to do.
    With metadata_only, documents to embed are skipped.
    """
    old = state.select(key, F.col("text_digest").alias("__t"), F.col("meta_digest").alias("__m"))
    joined = current.join(old, key, "left").join(stored.select(key, "n_stored"), key, "left")
    changed = F.col("__t").isNull() | (F.col("__t") != F.col("text_digest")) | (F.coalesce("n_stored", F.lit(0)) != F.col("n_chunks"))
    action = F.when(changed, "skip" if metadata_only else "embed").when(~F.col("__m").eqNullSafe(F.col("meta_digest")), "metadata").otherwise("skip")
    return joined.select(key, action.alias("action"))


def removed(state: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the state that are no longer current."""
    return state.join(current, key, "left_anti").select(key)


@dataclass(frozen=True)
class Index:
    """A stored keyword index: postings (term, key, tf, dl) in buckets of terms, and the corpus statistics."""

    postings: DataFrame
    stats: Stats
    buckets: int

    def of(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms (column term) only; the buckets of a bounded number of terms prune the scan."""
        bucket = _bucket(F.col("term"), self.buckets)
        return self.postings.join(terms.select("term", bucket.alias("bucket")), ["bucket", "term"]).drop("bucket")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, path: str, key: str = "chunk_id", most_documents: int | None = None, buckets: int = 64) -> Index:
    """Write the keyword index of chunks (key, text) to a folder, in one pass over the texts: postings by bucket of term, and the statistics.

    With most_documents (a choice of the caller, as of a first run), only the chunks of that many documents, the newest (sitting_date) first, ties by doc_id.
    """
    if most_documents is not None:
        newest = chunks.select("doc_id", "sitting_date").groupBy("doc_id").agg(F.max("sitting_date").alias("d")).orderBy(F.desc_nulls_last("d"), "doc_id").limit(most_documents)
        chunks = chunks.join(newest.select("doc_id"), "doc_id", "left_semi")
    posted = postings(chunks, key).withColumn("bucket", _bucket(F.col("term"), buckets))
    posted.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    sized = chunks.agg(F.count("*").alias("n"))
    total = chunks.sparkSession.read.parquet(f"{path}/postings").agg(F.sum("tf").alias("tokens"))
    sized.join(total).select("n", (F.coalesce("tokens", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avg_len"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return load(chunks.sparkSession, path)


def load(spark, path: str) -> Index:
    """The index that build() wrote."""
    row = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), Stats(row.n, float(row.avg_len)), row.buckets)
