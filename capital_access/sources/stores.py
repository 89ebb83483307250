"""Named bundles of tables, CSV output and the summary report."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

MANIFEST = "_tables"
MANIFEST_SCHEMA = (
    "version int, tables array<struct<name:string,path:string,columns:array<string>,partitioned_by:array<string>>>")


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet folder; partition folders get evenly sized files also when one is much larger."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def bundle_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows version, tables: what has been saved under a root; none where nothing has."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def save_bundle(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    root: str,
    pattern: str = "",
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Write the tables whose name matches ``pattern`` as a new version of the bundle; their names.

    A version has a folder of its own, and one row in the manifest, a file
    that is put into place when all tables are written. Until then, and after a
    failure between tables, readers find the former version whole. So a
    table may be read from the bundle it is saved to. One writer at a time;
    former versions stay until the folder's owner removes them.
    """
    chosen = {n: t for n, t in tables.items() if re.search(pattern, n)}
    version = (bundle_versions(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    folder, rows = f"{root}/{version:06d}-{uuid.uuid4().hex[:8]}", []
    for name, table in chosen.items():
        by = list((partition_by or {}).get(name, ()))
        save_table(table, f"{folder}/{name}", by)
        rows.append((name, f"{folder}/{name}", table.columns, by))
    spark.createDataFrame([(version, rows)], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return list(chosen)


def bundle_tables(spark: SparkSession, root: str, version: int | None = None) -> list[Row]:
    """Name, path, columns and partitioning of the tables of a version, the latest unless given."""
    saved = bundle_versions(spark, root)
    found = (saved if version is None else saved.where(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if found is None:
        raise ValueError(f"no bundle{'' if version is None else f' of version {version}'} at {root}")
    return found["tables"]


def load_bundle(
    spark: SparkSession, root: str, pattern: str = "", views: bool = False, version: int | None = None
) -> dict[str, DataFrame]:
    """Tables of a bundle by name, of its latest version unless given, optionally also as temporary views."""
    tables = {
        row["name"]: spark.read.parquet(row["path"]).select(*[F.col(f"`{c}`") for c in row["columns"]])
        for row in bundle_tables(spark, root, version)
        if re.search(pattern, row["name"])
    }
    if views:
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
    return tables


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_report(
    spark: SparkSession, tables: Mapping[str, DataFrame], root: str, suffix: str = "_summary"
) -> DataFrame:
    """One CSV folder per summary table and a manifest with row counts, which is returned.

    Rows are counted in the written files, so no summary is computed twice.
    """
    rows = []
    for name, table in tables.items():
        if not name.endswith(suffix):
            continue
        path = f"{root}/{name}"
        save_csv(table, path)
        written = spark.read.schema(table.schema).csv(path, header=True)
        rows.append((name, path, len(table.columns), written.count()))
    manifest = spark.createDataFrame(rows, "name string, path string, n_columns int, n_rows long")
    save_csv(manifest.coalesce(1), f"{root}/_manifest")
    return manifest
