"""Ranges of landed files, read from Python tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def locate(path: str):
    """(file system, path in it) of a path as Spark names it; raises where Python cannot reach that store."""
    from pyarrow import fs

    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), "/" + path[scheme.end() if scheme else 0:].lstrip("/")
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe=":/@"))


def reachable(path: str) -> bool:
    """Whether Python tasks can open files there. Some stores are known to Spark alone."""
    try:
        locate(path)
    except Exception:  # a missing driver library or unknown scheme, each with its own error
        return False
    return True


def listed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows path, length of all files below the paths; Spark lists them, and reads none."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")
