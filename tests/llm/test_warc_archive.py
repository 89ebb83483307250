"""Archives read back, by this package and by a plain reading of the format."""

import hashlib
import io

import pytest
import zstandard
from pyarrow import fs

from capital_access.llm import warc_archive as m

SHAPE = "page_id long, url string, html string"
LONG = "é<p>page</p>\r\n\r\n" * 100


def back(spark, df, rule=m.ArchiveRule()):
    archives = m.write_archives(df, m.archive_folder(spark), rule=rule)
    return archives, {(r.page_id, r.record_type): r for r in m.read_archives(archives).collect()}


def test_round_trip(spark):
    rows = [(k, f"http://x.example/{k}", f"<html>{k} {'body ' * (k % 50)}</html>") for k in range(400)]
    archives, found = back(spark, spark.createDataFrame(rows, SHAPE).repartition(2), m.ArchiveRule(archive_bytes=60_000, sample_bytes=20_000))
    assert archives.count() > 2 and {r.records > 0 for r in archives.collect()} == {True}
    for page_id, url, html in rows:
        r = found[page_id, "response"]
        assert (r.url, r.payload.decode(), r.payload_bytes, r.refers_to) == (url, html, len(html), None)
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest()


def test_the_dictionary_stands_in_a_leading_skippable_frame(spark):
    rows = [(k, None, f"<html><head><title>{k}</title></head><body>{hashlib.sha256(bytes([k % 256])).hexdigest()} common words of all pages</body></html>") for k in range(500)]
    archives, _ = back(spark, spark.createDataFrame(rows, SHAPE).coalesce(1), m.ArchiveRule(dictionary_bytes=2048))
    store, path = fs.FileSystem.from_uri(archives.first().path)
    raw = store.open_input_stream(path, compression=None).read()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and raw[8:12] == b"\x37\xa4\x30\xec"
    size = int.from_bytes(raw[4:8], "little")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size])).stream_reader(
        io.BytesIO(raw[8 + size:]), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 501 and plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    with pytest.raises(ValueError):
        list(m.archive_frames(io.BytesIO(raw[:-5])))


def test_revisits_nulls_ties_and_empty(spark):
    rows = [(5, "u5", LONG), (9, "u\r\n9", LONG), (7, None, LONG), (None, "u", LONG), (9, "u9", LONG), (1, "s", "short"), (2, "s", "short"), (3, "n", None), (4, "e", "")]
    archives, found = back(spark, spark.createDataFrame(rows, SHAPE))
    assert {k: r.refers_to for k, r in found.items()} == {
        (5, "revisit"): 9, (7, "revisit"): 9, (None, "revisit"): 9, (9, "response"): None, (1, "response"): None, (2, "response"): None, (3, "response"): None, (4, "response"): None}
    assert found[5, "revisit"].payload is None and found[5, "revisit"].payload_bytes == len(LONG.encode())
    assert found[5, "revisit"].payload_digest == found[9, "response"].payload_digest and found[3, "response"].payload == b""
    assert m.read_archives(archives).count() == len(rows)
    empty, _ = back(spark, spark.createDataFrame([], SHAPE))
    assert empty.count() == 0 and m.read_archives(empty).collect() == []
    _, bare = back(spark, spark.createDataFrame([(1, "x", 3, 4)], "page_id long, html string, size int, original int"))
    assert bare[1, "response"].url is None


def test_a_damaged_payload_is_noticed():
    record = m.page_record(1, "u", b"payload", None, m.ArchiveRule())
    assert m.parse_page(record)[6] == b"payload"
    with pytest.raises(ValueError):
        m.parse_page(record.replace(b"payload", b"paylaod"))


def test_text_ids_and_long_payloads_come_back(spark):
    long = "0123456789é" * 300_000  # several reads of a stream
    rows = [("a", "u", LONG), ("b\r\nWARC-Type: x", "u", LONG), ("é 7%", "u", "short"), ("", "u", long), (None, "u", "short")]
    archives = m.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), m.archive_folder(spark))
    found = {r.page_id: r for r in m.read_archives(archives, "string").collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {
        "a": ("revisit", rows[1][0]), rows[1][0]: ("response", None), "é 7%": ("response", None), "": ("response", None), None: ("response", None)}
    assert bytes(found[""].payload).decode() == long
