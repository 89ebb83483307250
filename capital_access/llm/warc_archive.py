"""Web pages as dictionary-compressed WARC archives, and back."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from capital_access.functions.nulls import as_col
from capital_access.session import scratch_path, settle

# Magic numbers of the skippable frame that holds a dictionary and of dictionaries, the profile of revisits.
_SKIPPABLE = 0x184D2A5D
_DICTIONARY_MAGIC = 0xEC30A437
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


@dataclass(frozen=True)
class ArchiveRule:
    """How archives are written.

    The dictionary of an archive is trained on its first records, up to
    ``sample_bytes``, which wait in memory until then; what is in a partition is
    dealt by hash, so these are like the others. An archive is closed at
    ``archive_bytes`` of records before compression. Equal payloads of
    ``least_revisit`` bytes or more are stored once.
    """

    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 4 << 20
    archive_bytes: int = 1 << 30
    least_revisit: int = 1000
    level: int = 6
    date: str = "2026-01-01T00:00:00Z"


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, rule: ArchiveRule) -> bytes:
    """One WARC record; line ends in values, which would end a header, become spaces."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", rule.date), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: object, payload: bytes) -> str:
    """The same page has the same name on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{hashlib.sha256(payload).hexdigest()}')}>"


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, rule: ArchiveRule) -> bytes:
    """A response with the payload, or a revisit without it where the payload is stored under another page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Page-ID", quote(str(page_id)))] if page_id is not None else []
    if refers_to is None:
        return _record("response", record_id(page_id, payload), headers, http + payload, rule)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, payload)), ("Refers-To-Page-ID", quote(str(refers_to)))]
    return _record("revisit", record_id(page_id, payload), headers, http, rule)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from records; none where they are too few or too small for one, as the format allows."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """One archive: a skippable frame with the dictionary, then a frame for each record.

    It is written under another name and moved to its own when complete.
    """

    def __init__(self, store: fs.FileSystem, path: str, rule: ArchiveRule):
        self.store, self.path, self.rule = store, path, rule
        self.part = f"{path}.part"
        self.waiting: list[bytes] = []
        self.bytes = self.records = 0
        self.out: BinaryIO | None = None
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.bytes += len(record)
        self.records += 1
        if self.out is not None:
            self._frame(record)
            return
        self.waiting.append(record)
        if self.bytes >= self.rule.sample_bytes:
            self._open()

    def _frame(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))

    def _open(self) -> None:
        raw = train_dictionary(self.waiting, self.rule.dictionary_bytes)
        trained = zstandard.ZstdCompressionDict(raw) if raw else None
        self.compressor = zstandard.ZstdCompressor(level=self.rule.level, dict_data=trained, write_checksum=True, write_content_size=True)
        self.out = self.store.open_output_stream(self.part, compression=None)
        if raw:
            self.out.write(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
        info = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, os.path.basename(self.path))}>"
        self._frame(_record("warcinfo", name, [("Content-Type", "application/warc-fields")], info, self.rule))
        for record in self.waiting:
            self._frame(record)
        self.waiting = []

    def close(self) -> None:
        if self.out is None:
            self._open()
        self.out.close()
        self.store.move(self.part, self.path)


def archive_frames(stream: BinaryIO) -> Iterator[bytes]:
    """The content of every frame but the skippable one, one at a time."""
    head = stream.read(8)
    trained = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _SKIPPABLE:
        raw = stream.read(struct.unpack("<I", head[4:])[0])
        if struct.unpack("<I", raw[:4])[0] != _DICTIONARY_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)  # the format lets dictionaries be compressed
        trained, head = zstandard.ZstdCompressionDict(raw), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    left = head
    while True:
        frame, got = decompressor.decompressobj(), []
        while not frame.eof:
            left = left or stream.read(_READ)
            if not left:
                break
            got.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        if not frame.eof:
            if got:
                raise ValueError("the archive ends within a frame")
            return
        yield b"".join(got)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {lines[0]}")
    return headers, rest[:size]


def parse_page(record: bytes) -> tuple | None:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload); None for the archive's own record.

    The payload of a response must have the length and digest that its record states.
    """
    headers, block = parse_record(record)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} differs from its digest")
    page_id, refers_to = (None if headers.get(h) is None else unquote(headers[h]) for h in ("page-id", "refers-to-page-id"))
    return (page_id, headers.get("warc-target-uri"), kind, size, digest, refers_to,
            payload if kind == "response" else None)


def with_originals(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Rows page_id, url, html, refers_to: the page that stores an equal payload of ``least_bytes`` or more, if it is another.

    Payloads are told apart by SHA-1 and length. Those that occur once are left
    out of the written table of originals, and the join with it can split a
    payload that a third of all pages share.
    """
    size, digest = F.octet_length("html"), F.sha1(F.encode("html", "utf-8"))
    read = pages.select(as_col(id_col).alias("page_id"), F.coalesce(as_col(html_col), F.lit("")).alias("html"),
                        *([as_col("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]))
    keyed = read.withColumns({"size": size, "digest": digest})
    originals = settle(
        keyed.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "size", "original"), "originals")
    return keyed.join(originals, ["digest", "size"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", rule: ArchiveRule = ArchiveRule()) -> DataFrame:
    """Write every page to archives in ``folder``, runs a job; gives path, records, bytes (before compression) of each archive.

    Of pages with equal payloads of ``rule.least_revisit`` bytes or more, that
    with the greatest id is a response and the others revisit it; rows that
    repeat the greatest id are all responses, as are rows without an id where
    none has one. A missing payload is an empty one; a missing address or id has
    no header. An empty table gives no archive.

    ``folder`` is a URI that all executors reach (any file system pyarrow knows).
    Every task attempt writes its rows as they come, an archive at a time, under
    names of its own. The returned table, written by Spark, lists the archives of
    the attempts that counted; what a lost or repeated attempt left is not in it.
    """
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt, number, writer, done = TaskContext.get().taskAttemptId(), 0, None, []
        for frame in frames:
            for page_id, url, html, refers_to in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"]):
                if writer is None:
                    writer = ArchiveWriter(store, f"{base}/pages-{attempt:06d}-{number:04d}.warc.zst", rule)
                    number += 1
                writer.add(page_record(None if pd.isna(page_id) else page_id, url, html.encode("utf-8", "surrogatepass"),
                                       None if pd.isna(refers_to) else refers_to, rule))
                if writer.bytes >= rule.archive_bytes:
                    writer.close()
                    done.append(writer)
                    writer = None
        if writer is not None:
            writer.close()
            done.append(writer)
        if done:
            yield pd.DataFrame({"path": [f"{folder}/{os.path.basename(w.path)}" for w in done],
                                "records": [w.records for w in done], "bytes": [w.bytes for w in done]})

    chosen = with_originals(pages, id_col, html_col, rule.least_revisit)
    ids = chosen.select(*(F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")), "url", "html")
    return settle(ids.select("page_id", "url", "html", "refers_to").mapInPandas(write, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """Rows page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of all archives listed under ``path``.

    Ids are text in the records, percent-coded; ``id_type`` is the type they come back in.
    Each archive is read as a stream, record by record, by one task. The payload
    of a revisit is missing: it is that of the page it refers to.
    """
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for record in archive_frames(stream):
                        page = parse_page(record)
                        if page is not None:
                            rows.append(page)
                            held += len(record)
                        if held >= 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    paths = archives.select("path")
    paths = paths.repartition(max(1, paths.count()))  # a task for each, as the number of partitions is asked for
    shape = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    return paths.mapInPandas(read, shape).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives below the shared one, as a URI."""
    path = scratch_path(spark, "warc")
    if "://" in path:
        return path
    return f"file://{os.path.abspath(path.removeprefix('file:'))}"
