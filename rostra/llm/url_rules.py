"""URL filters: sort-merge range join of reversed-host keys with prefix rules.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes on from there up
to ``?``, ``#`` or the end. Null urls and urls without ``://`` have neither (both empty). A rule (host, path, verdict) fits its
host and all subdomains where the url's path starts with the rule's. The longest rule (host, then path, by characters) wins; a
rule given twice with different verdicts blocks. Without a fitting rule the verdict is DEFAULT.

Canonical key: the host's labels reversed, a separator, the path. A rule covers the interval of keys that start with its own key.
Since a rule also fits subdomains, each distinct (host, path) is probed once for each parent host. Rules and probes meet
in ranges of the key: a rule goes to every range its interval reaches, a probe to one range (a key that is the border of
several ranges is spread over them). In a range both are sorted by key, and one sweep keeps the stack of the nested rules
that are active at the current key, so its memory is the depth of nesting. Neither side is broadcast.

An empty rule host fits every host that isn't empty; an empty path fits every path; null parts of a rule count as empty.
Repeated urls are judged once; extra columns are kept; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import bound_batches

DEFAULT = "allow"
#: Between host and path, and between labels; below every character a key holds.
_END, _DOT = "\x01", "\x02"
#: Keys looked at for each range border, and the length a border is cut to: bound what the driver sees.
SAMPLE, BORDER = 32, 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The url's host, or the empty string."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The url's path, or the empty string."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), _DOT), F.lit(_END), path)


def _borders(keys: DataFrame, parts: int) -> list[str]:
    """parts - 1 borders from a bounded sample of keys, chosen by hash; a hot key may be the border of several ranges."""
    if parts < 2:
        return []
    rows = keys.select(F.substring("key", 1, BORDER).alias("key"), F.xxhash64("key", "id").alias("h")).orderBy("h").limit(parts * SAMPLE).collect()
    got = sorted(r.key for r in rows)
    return [got[len(got) * k // parts] for k in range(1, parts)] if got else []


def _probe_parts(borders: list[str]):
    def run(keys: pa.Array, ids: pa.Array) -> pa.Array:
        edges = np.array(borders, dtype=object)
        own = np.array(keys.to_pylist(), dtype=object)
        low, high = np.searchsorted(edges, own, side="left"), np.searchsorted(edges, own, side="right")
        spread = np.abs(ids.to_numpy()) % (high - low + 1)
        return pa.array((low + spread).astype(np.int32))

    run.__annotations__ = {"keys": pa.Array, "ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")


def _rule_parts(borders: list[str]):
    def run(keys: pa.Array) -> pa.Array:
        edges = np.array(borders, dtype=object)
        own = keys.to_pylist()
        low = np.searchsorted(edges, np.array(own, dtype=object), side="left")
        # Borders are cut, so a border that the rule's key goes on from also opens a range the rule reaches.
        high = np.searchsorted(edges, np.array([k + "\U0010ffff" for k in own], dtype=object), side="right")
        return pa.array([list(range(a, z + 1)) for a, z in zip(low, high, strict=True)], pa.list_(pa.int32()))

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (part, key, kind, rule, length, host, path) in order, the longest active rule of each probe."""
    stack: list[tuple[str, str, str, int]] = []
    part = None
    for batch in batches:
        hosts, paths, rules, verdicts, lengths = [], [], [], [], []
        for own, key, kind, rule, verdict, length, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != part:
                part, stack = own, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict, length))
            elif stack:
                _, rule, verdict, length = stack[-1]
                hosts.append(host)
                paths.append(path)
                rules.append(rule)
                verdicts.append(verdict)
                lengths.append(length)
        text = [pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts)]
        yield pa.RecordBatch.from_arrays([*text, pa.array(lengths, pa.int64())], names=["host", "path", "rule", "verdict", "length"])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, else null) and verdict (else ``default``).

    rules has the columns host, path (with its leading slash) and verdict. Columns of pages with those four names are replaced.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    distinct = named.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.when(F.col("host") == "", F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.slice(labels, k, F.size(labels))))
    probes = distinct.select("host", "path", F.explode(F.concat(parents, F.when(F.col("host") != "", F.array(F.array().cast("array<string>"))).otherwise(F.array().cast("array<array<string>>")))).alias("own"))
    probes = probes.select("host", "path", _key(F.col("own"), F.col("path")).alias("key"), F.xxhash64("host", "path").alias("id"))

    clean = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.coalesce("verdict", F.lit(default)).alias("v")
    )
    clean = clean.groupBy("h", "p").agg(F.max("v").alias("v"))  # block is above allow
    own = F.when(F.col("h") == "", F.array().cast("array<string>")).otherwise(F.split("h", r"\."))
    ruled = clean.select(_key(own, F.col("p")).alias("key"), F.concat("h", "p").alias("rule"), "v", (F.char_length("h") * (1 << 24) + F.char_length("p")).cast("long").alias("length"))

    borders = _borders(probes, parts)
    rows = probes.select(_probe_parts(borders)("key", "id").alias("part"), "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("long").alias("length"), "host", "path")
    rows = rows.union(
        ruled.select(F.explode(_rule_parts(borders)("key")).alias("part"), "key", F.lit(0).alias("kind"), "rule", F.col("v").alias("verdict"), "length", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    )
    matched = rows.repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind").mapInArrow(_sweep, "host string, path string, rule string, verdict string, length long")
    best = matched.groupBy("host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("__best"))
    judged = named.join(best, ["host", "path"], "left")
    extra = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*extra, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
