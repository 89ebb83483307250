"""Scans of landed extracts. Every reader takes a declared schema; nothing is inferred."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from capital_access.functions.nulls import as_col
from capital_access.sources.files import listed, locate, reachable


def string_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def text_lines(spark: SparkSession, paths: str | Sequence[str], with_file: bool = False) -> DataFrame:
    """One row per line of all files; ``file`` holds the name of the file."""
    lines = spark.read.text(paths)
    return lines.select("value", F.col("_metadata.file_name").alias("file")) if with_file else lines


def header_names(first: str) -> list[str]:
    """Column names of a header line as Spark gives them: unnamed and repeated ones get their place."""
    names = next(csv.reader([first]))
    times = Counter(n.lower() for n in names)
    return [f"_c{k}" if n == "" else f"{n}{k}" if times[n.lower()] > 1 else n for k, n in enumerate(names)]


def csv_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows header, files: the files below the paths by the names in their first line that is not blank.

    One job, whatever the number of files: each is opened by a task that reads
    until that line ends. In a store that Spark alone can reach, the lines come
    from a scan of the files. A file without such a line is left out.
    """
    files = listed(spark, paths).where("length > 0").select("path")
    schema = "path string, header array<string>"

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                system, name = locate(path)
                with system.open_input_stream(name, buffer_size=1 << 16) as raw:
                    lines = io.TextIOWrapper(raw, "utf-8-sig", errors="replace")
                    first = next((line for line in lines if line.strip()), None)
                    if first is not None:
                        found.append((path, header_names(first.rstrip("\r\n"))))
            yield pd.DataFrame(found, columns=["path", "header"])

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "header": [header_names(v) for v in frame["first"]]})

    first_file = files.first()
    if first_file is None or reachable(first_file["path"]):
        headers = files.mapInPandas(opened, schema)
    else:
        # A block's first line comes first in the task that reads the block.
        lines = spark.read.text(paths).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        headers = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("value").alias("first")).mapInPandas(parsed, schema)
    return headers.groupBy("header").agg(F.collect_list("path").alias("files"))


def csv_strings(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], missing: str = "NA") -> DataFrame:
    """CSV files with every column kept as text, so that codes keep their zeros.

    Blank fields are empty texts; only the text ``missing`` is missing. Columns
    are bound by name: files may have them in different orders, and have others;
    one that a file lacks is missing in its rows. The headers of all files are
    read by one job, and files with the same header are one scan; the names of
    the files come to the driver, which Spark needs to plan a scan in any case.
    """
    by_header = [(tuple(r["header"]), sorted(r["files"])) for r in csv_headers(spark, paths).collect()]
    if not by_header:
        return spark.createDataFrame([], string_schema(columns))
    parts = []
    for header, same in sorted(by_header):
        # An unquoted blank is read as the null value, so that must be no text of the file.
        read = spark.read.schema(string_schema(header)).csv(
            same if len(by_header) > 1 else paths, header=True, enforceSchema=True, nullValue="\u0000")
        kept = [
            F.when(as_col(c).isNull(), F.lit("")).when(as_col(c) != missing, as_col(c)).alias(c) if c in header
            else F.lit(None).cast("string").alias(c) for c in columns
        ]
        parts.append(read.select(kept))
    return reduce(DataFrame.unionByName, parts)


def csv_typed(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(paths, header=True, enforceSchema=False)


def json_records(
    spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, multi_line: bool = False
) -> DataFrame:
    """JSON records: one per line, or with ``multi_line`` arrays of records.

    A file of the second kind cannot be split; land large extracts as lines.
    """
    return spark.read.schema(schema).json(paths, multiLine=multi_line)


def fixed_width(lines: DataFrame, layout: Sequence[tuple[str, int]], line: str = "value") -> DataFrame:
    """Cut fields of given widths out of each line; text after the last field is dropped."""
    fields: list[Column] = []
    start = 1
    for name, width in layout:
        fields.append(F.substring(line, start, width).alias(name))
        start += width
    others = [c for c in lines.columns if c != line]
    return lines.select(*others, *fields)


def yearly_parquet(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """A table stored by year; the list of years prunes folders, not rows."""
    table = spark.read.parquet(path)
    return table if years is None else table.filter(F.col("year").isin(list(years)))
