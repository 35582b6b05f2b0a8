"""Paths below the folder that driver and executors share, and their removal.

Tables go to the folder the session names in ``spark.checkpoint.dir``, so they outlive any executor. Only a local-mode
session without that setting (tests, laptops) falls back to a folder of this machine.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import SparkSession

_fallback: str | None = None
_written: list[tuple[SparkSession, str]] = []
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or (local mode only, where unset) a temporary folder."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="rostra-")
    return f"file://{_fallback}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed by release() or at exit."""
    path = f"{shared_dir(spark)}/rostra/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (own := _scratch.get()) is not None:
        own.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete on leaving what this thread has written within; a path taken from the list stays."""
    own: list[str] = []
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        for path in own:
            with contextlib.suppress(Exception):
                remove(spark, path)


def mark() -> int:
    """A point in the list of written paths, for release()."""
    return len(_written)


def release(since: int = 0) -> None:
    """Delete what was written after mark() returned ``since``; call it only when the results are written."""
    while len(_written) > since:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            remove(spark, path)


atexit.register(release)
