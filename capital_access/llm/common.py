"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from capital_access.functions.nulls import as_col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id: rows alike in id and text are one document.

    A missing text is told apart from an empty one.
    """
    return F.xxhash64(as_col(id_col), as_col(text_col), as_col(text_col).isNull())


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many ``_`` behind it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A to Z in lower case and every other character untouched; missing counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def small_batches(frames: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The same rows in slices, so that what is derived from a batch stays small beside the batch."""
    return chain.from_iterable((frame.iloc[k:k + rows] for k in range(0, len(frame), rows)) for frame in frames)


def bounded_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """All rows if there are at most ``most``, else about 0.95 times that many, by a hash of the key, and never more than ``most``.

    The same rows whatever the partitioning; a task keeps its share only, so no
    task gathers more than ``most`` rows.
    """
    rows = df.count()
    if rows <= most:
        return df
    share = int((1 << 32) * 0.95 * most / rows)
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 32)) < share).limit(most)
