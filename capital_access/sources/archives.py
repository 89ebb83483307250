"""Lines of chosen members of zip archives."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from capital_access.sources.files import listed, locate, reachable

LINE_SCHEMA = "archive string, member string, line_no long, value string"
_ARROW_SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
#: Bytes that are read at a time.
_BLOCK = 1 << 20


def chosen_members(names: Sequence[str], patterns: Sequence[str], every: bool, path: str) -> list[str]:
    """The matches of the first pattern that has any, or of all patterns; none is an error."""
    hits = [[n for n in names if re.search(p, n)] for p in patterns]
    found = list(dict.fromkeys(sum(hits, []) if every else next((h for h in hits if h), [])))
    if not found:
        raise ValueError(f"no member of {path} matches {list(patterns)}")
    return found


def member_lines(archive: zipfile.ZipFile, member: str, encoding: str) -> Iterator[list[str]]:
    """The lines of a member, decompressed as a stream, some at a time."""
    decoder, rest = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder(encoding)(), translate=True), ""
    with archive.open(member) as raw:
        while True:
            block = raw.read(_BLOCK)
            *lines, rest = (rest + decoder.decode(block, final=not block)).split("\n")
            if not block and rest:
                lines.append(rest)
            if lines:
                yield lines
            if not block:
                return


def zip_lines(archives: DataFrame, member_patterns: Sequence[str], every: bool = False, encoding: str = "latin-1") -> DataFrame:
    """One row per line, from a table of (path, content).

    For archives that are values of a table: each is held by the task that has
    its row, so it has at most 2 GB. :func:`read_zip_lines` reads files.
    """
    patterns = list(member_patterns)

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in chosen_members(archive.namelist(), patterns, every, path):
                        line_no = 0
                        for lines in member_lines(archive, member, encoding):
                            yield pd.DataFrame({
                                "archive": path, "member": member, "line_no": range(line_no + 1, line_no + 1 + len(lines)), "value": lines})
                            line_no += len(lines)

    return archives.select("path", "content").mapInPandas(unpack, LINE_SCHEMA)


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive whose directory, and whose members when they are read, come by ranges of the file."""
    system, name = locate(path)
    with system.open_input_file(name) as file, io.BufferedReader(file, _BLOCK) as buffered:
        try:
            archive = zipfile.ZipFile(buffered)
        except zipfile.BadZipFile as error:
            raise ValueError(f"{path} has no readable directory of members: {error}") from error
        with archive:
            yield archive


@dataclass
class Members(InputPartition):
    """Members of one archive that a task reads."""

    path: str
    names: tuple[str, ...]


class ZipMembersReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.patterns = json.loads(options["files"]), json.loads(options["patterns"])
        self.every, self.encoding = options["every"] == "true", options["encoding"]
        self.together = int(options["together"])

    def _split(self, path: str) -> list[Members]:
        with opened(path) as archive:
            names = chosen_members(archive.namelist(), self.patterns, self.every, path)
            sizes = {n: archive.getinfo(n).compress_size for n in names}
        parts, held = [], 0
        for name in names:
            if parts and held + sizes[name] <= self.together:
                parts[-1].append(name)
                held += sizes[name]
            else:
                parts.append([name])
                held = sizes[name]
        return [Members(path, tuple(p)) for p in parts]

    def partitions(self) -> list[Members]:
        with ThreadPoolExecutor(32) as pool:
            return [part for parts in pool.map(self._split, self.files) for part in parts]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as archive:
            for name in partition.names:
                line_no = 0
                for lines in member_lines(archive, name, self.encoding):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.path] * n), pa.array([name] * n), pa.array(range(line_no + 1, line_no + 1 + n), pa.int64()),
                         pa.array(lines, pa.string())], schema=_ARROW_SCHEMA)
                    line_no += n


class ZipMembers(DataSource):
    """Lines of members of archives, each partition some members of one archive."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipMembersReader(self.options)


def read_zip_lines(
    spark: SparkSession, paths: str | Sequence[str], member_patterns: Sequence[str], every: bool = False, encoding: str = "latin-1",
    together: int = 32 << 20,
) -> DataFrame:
    """One row per line of the chosen members: archive, member, line_no, value.

    The patterns are tried in turn against the member names of an archive, as
    extracts changed their naming over the years: the first pattern that
    matches decides, and all its matches are read (``every=True`` reads the
    matches of all patterns). An archive without any match is an error, and so is
    one whose directory cannot be read.

    The directories are read when the scan is planned, 32 at a time. A member is
    read by one task, members of less than ``together`` compressed bytes in all
    by the same one, and a task reads only its members' ranges of the file. So
    an archive of any size is never held, and its members are read side by
    side; a member is a stream that cannot be split. In a store that Spark alone
    can reach, an archive is one task's work and has at most 2 GB.
    """
    files = [row["path"] for row in listed(spark, paths).select("path").collect()]
    if not files:
        return spark.createDataFrame([], LINE_SCHEMA)
    if not reachable(files[0]):
        return zip_lines(spark.read.format("binaryFile").load(paths), member_patterns, every, encoding)
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(
        files=json.dumps(files), patterns=json.dumps(list(member_patterns)), every=str(every).lower(), encoding=encoding, together=str(together)).load()
