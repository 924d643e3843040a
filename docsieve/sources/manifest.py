"""What a stored run was made of: its settings, its input and the mark that it was finished.

A run's key is a digest of its settings and of the content it read, so a change of either
makes the run due again, and the same content under other file names does not.  The key is
written last, whole or not at all: output without a key is that of a run that broke off.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

FOLDER = "_runs"  # readers of tables pass over names with this first letter


def run_key(settings: Mapping, content: Iterable[str]) -> str:
    """Digest of settings (anything JSON can state) and the fingerprints of what is read."""
    stated = json.dumps([settings, *content], sort_keys=True, default=str)
    return hashlib.sha256(stated.encode()).hexdigest()


def _path(spark: SparkSession, folder: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{FOLDER}/{name}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_key(spark: SparkSession, folder: str, name: str) -> str | None:
    """The key of the finished run ``name`` below ``folder``; None if there is none."""
    path, store = _path(spark, folder, name)
    if not store.exists(path):
        return None
    stream = store.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def begin(spark: SparkSession, folder: str, name: str) -> None:
    """Take the mark off: from now on the run is unfinished."""
    path, store = _path(spark, folder, name)
    store.delete(path, False)


def commit(spark: SparkSession, folder: str, name: str, key: str) -> None:
    """Mark the run as finished."""
    path, store = _path(spark, folder, name)
    part, _ = _path(spark, folder, f".{name}.part")
    stream = store.create(part, True)
    try:
        stream.write(bytearray(key.encode()))
    finally:
        stream.close()
    store.delete(path, False)
    if not store.rename(part, path):
        raise OSError(f"cannot mark {name!r} as finished below {folder}")


def finished(spark: SparkSession, folder: str, keys: Mapping[str, str]) -> list[str]:
    """Those of the runs (name to key) whose stored key is the same."""
    return [name for name, key in keys.items() if stored_key(spark, folder, name) == key]
