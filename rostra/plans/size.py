"""Size checks: a side is broadcast only if it is proven small, otherwise Spark joins it by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of their values, up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 27


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most ``rows`` rows and about ``most_bytes`` bytes; no more rows than that are looked at."""
    flat = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    sizes = [F.octet_length(F.col(f"`{c}`")) for c in flat] + ([F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in nested])))] if nested else [])
    total = F.sum(sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(8 * len(df.columns))).cast("long"))
    n, held_bytes = df.limit(rows + 1).agg(F.count("*"), total).first()
    return n <= rows and (held_bytes or 0) <= most_bytes


def held(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df's rows as a local table if there are at most ``rows``, so that what gives them runs once; else df as it is. For narrow rows."""
    table = df.limit(rows + 1).toArrow()
    return df.sparkSession.createDataFrame(table, df.schema) if table.num_rows <= rows else df


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small, else df as it is."""
    return F.broadcast(df) if is_small(df, rows) else df
