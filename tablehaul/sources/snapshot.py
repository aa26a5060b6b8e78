"""One version of the input for all tables: take a token, open, and check that the token still holds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def file_token(spark: SparkSession, base: str) -> str:
    """Hash of names, lengths and times of all files under a folder, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        s = files.next()
        found.append(f"{s.getPath().toString()}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def aligned(token: Callable[[], str], open_all: Callable[[], T], attempts: int = 5, close: Callable[[T], None] | None = None, skip: bool = False) -> T:
    """What ``open_all`` gives, taken while the source stood still: the token is equal before and after.

    ``skip``: the caller answers for a source that doesn't change. Fails after ``attempts`` rather than hand out
    snapshots of different moments.
    """
    if skip:
        return open_all()
    for _ in range(attempts):
        before = token()
        got = open_all()
        if token() == before:
            return got
        if close:
            close(got)
    raise RuntimeError(f"the source changed during each of {attempts} attempts to open it; stop its writers or say that it doesn't change")
