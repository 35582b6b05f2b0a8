"""File sources and sinks: JSON lines, tables by document, reject lists, seeds, query logs, configuration overlays.

Writers overwrite whole documents (dynamic partition overwrite), so a repeated or resumed run leaves the same table; Spark's commit protocol makes each
write visible at once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with known columns only; a missing path is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The catalog; records without a source are of the older layout, whose listing url was item_url."""
    own = read_json(spark, path, f"{schema}, item_url string")
    old = F.col("source").isNull()
    empty = F.array().cast("array<string>")
    listing = F.when(old, F.coalesce("item_url", "listing_url", F.lit(""))).otherwise(F.coalesce("listing_url", F.lit("")))
    lists = {c: F.coalesce(c, empty) for c in ("alternate_urls", "superseded_urls", "previous_sha256")}
    return own.withColumns({"listing_url": listing, "source": F.coalesce("source", F.lit("repositori")), **lists}).drop("item_url")


def write_documents(records: DataFrame, path: str) -> None:
    """The catalog as one file of JSON lines, by date (one row a sitting)."""
    records.orderBy("sitting_date").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_document(df: DataFrame, path: str, key: str = "doc_id", fmt: str = "parquet") -> None:
    """Replace the documents in df, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(fmt).save(path)


def delete_documents(spark: SparkSession, path: str, keys: DataFrame, to: str, key: str = "doc_id") -> None:
    """The table at path without some documents, written to another path."""
    spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_anti").write.mode("overwrite").partitionBy(key).parquet(to)


def update_metadata(stored: DataFrame, metadata: DataFrame, key: str, vector: list[str]) -> DataFrame:
    """stored rows with new metadata by key, their vectors as they were."""
    return stored.select(key, *vector).join(metadata, key)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").option("sep", "\t").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def public_seed(records: DataFrame, allowed: list[str]) -> DataFrame:
    """(doc_id, sitting_date), provided that the table has no column outside ``allowed``."""
    extra = sorted(set(records.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns not meant for the public: {extra}")
    return records.select("doc_id", "sitting_date")


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors as 8-bit integers: the product is of the elements' own type (an integer factor would make it a double, whose halves round elsewhere)."""
    return vectors.withColumn(column, F.transform(column, lambda x: F.round(x * F.lit(127).cast("float")).cast("tinyint")))


def overlaid(base: dict, over: dict) -> dict:
    """base with over's values, tables merged key by key."""
    return {k: overlaid(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def columns_of(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).names


def uncached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a result cache (content digest, page, version, ...) doesn't hold yet."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")
