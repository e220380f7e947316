"""Versions of a stored dataset: data directories that never change, and small manifests that name them.

A manifest is created under the next number, which fails if that number is taken, and counts once its last line is
the end mark.  So readers see the version before or the one after, never half of one; a job that dies before
its commit leaves the old version as it was, and two writers cannot both commit on top of the same version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER, END = "_versions", "end"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(name: str) -> str:
    """A directory below the root that nobody else writes to (relative, so that a root can be moved)."""
    return f"data/{name}-{uuid.uuid4().hex[:12]}"


def _read(spark: SparkSession, path) -> dict | None:
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    head, _, mark = text.rpartition("\n")
    return json.loads(head) if mark == END else None


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest whole manifest; (0, {}) where nothing was ever committed."""
    return next(iter(_manifests(spark, root)), (0, {}))


def _manifests(spark: SparkSession, root: str):
    folder, fs = _fs(spark, f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return
    for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName(), reverse=True):
        content = _read(spark, status.getPath())
        if content is not None:
            yield int(status.getPath().getName()), content


def commit(spark: SparkSession, root: str, content: dict, after: int) -> int:
    """Make ``content`` the version that follows version ``after``."""
    path, fs = _fs(spark, f"{root}/{FOLDER}/{after + 1:012d}")
    if fs.exists(path) and _read(spark, path) is None:
        fs.delete(path, False)  # a writer died before the end mark: this version never was
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(f"{json.dumps(content)}\n{END}".encode()))
    finally:
        stream.close()
    return after + 1


def current_dir(spark: SparkSession, root: str) -> str:
    """Where the newest version of a one-directory dataset lies; the root itself where it has no versions."""
    content = latest(spark, root)[1]
    return f"{root}/{content['dir']}" if content else root


def clean(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete data directories that none of the ``keep`` newest versions names; for times without writers."""
    named = [json.dumps(content) for _, content in list(_manifests(spark, root))[:keep]]
    folder, fs = _fs(spark, f"{root}/data")
    gone = 0
    for status in (fs.listStatus(folder) if fs.exists(folder) else []):
        if not any(f"data/{status.getPath().getName()}" in text for text in named):
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
