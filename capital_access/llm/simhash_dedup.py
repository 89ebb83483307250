"""Near-duplicate documents by SimHash fingerprints, found through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import ascii_lower, fresh_names, row_key
from capital_access.llm.components import connected_components
from capital_access.session import settle

#: Fixed value: generator polynomial of the perfect [23, 12, 7] Golay code.
_GENERATOR = 0b101011100011
#: (first bit, width) of the three segments of a fingerprint.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; each is 1 if more than half of the shingles' XXH64 (seed 42) have it.

    Words are separated by ASCII white space; A to Z are lower-cased; repeated
    shingles count each time. Fewer words than a shingle make one shingle of
    all, no words at all (an empty or missing text) make 0.
    """
    words = ascii_lower(text).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle))))),
                         "<u8", len(words) - shingle + 1)
    ones = sum(np.unpackbits(hashes[k:k + _BLOCK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
               for k in range(0, len(hashes), _BLOCK))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator; 0 for code words."""
    left = words.astype("i8")
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ _GENERATOR << bit - 11, left)
    return left


Tables = tuple[np.ndarray, np.ndarray]


def golay_tables() -> Tables:
    """For each of the 2048 syndromes the error patterns of weight four or less (six columns) and their number.

    A word at distance three from its code word, as most are, lies at distance
    four from five others; any other word has only its own within four bits.
    """
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], "i8")
        for pattern, s in zip(patterns.tolist(), _syndrome(patterns).tolist()):
            found[s].append(pattern)
    return np.array([(p + [0] * 6)[:6] for p in found], "i8"), np.array([len(p) for p in found])


def golay_indices(words: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the code words within four bits of each 23-bit word, padded to six columns; which of these count.

    Any two words that differ in at most two bits share an index: a word between
    them, one bit off either, is within three bits of some code word.
    """
    patterns, numbers = tables
    s = _syndrome(words)
    return (words[:, None] ^ patterns[s]) >> 11, np.arange(6) < numbers[s][:, None]


def search_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): keys of which two fingerprints share one if they differ in at most two bits.

    Of three segments one has no error, and the next one round the circle can
    be chosen so that it has at most one: two errors elsewhere leave a segment
    without error followed by one with at most one. So a key is a whole segment
    beside an index of a code word near the next one.
    """
    values, tables = fingerprints.astype("u8"), golay_tables()
    parts = [(values >> np.uint64(at) & np.uint64((1 << width) - 1)).astype("i8") for at, width in _SEGMENTS]
    places, keys = [], []
    for k in range(3):
        indices, counts = golay_indices(parts[(k + 1) % 3], tables)
        row, column = np.nonzero(counts)
        places.append(row)
        keys.append(k << 40 | parts[k][row] << 12 | indices[row, column])
    return np.concatenate(places), np.concatenate(keys)


def _keys(prints: DataFrame) -> DataFrame:
    """Rows (key, fp) for distinct fingerprints."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fp"].to_numpy()
            place, key = search_keys(values.view("u8"))
            yield pd.DataFrame({"key": key, "fp": values[place]})

    return prints.mapInPandas(keyed, "key long, fp long")


def fingerprint_links(prints: DataFrame, max_bits: int = 2, small_bucket: int = 128) -> DataFrame:
    """Rows (a, b) that connect all distinct fingerprints ``fp`` differing in at most ``max_bits`` (0 to 2) bits.

    Buckets of at most ``small_bucket`` fingerprints are joined with themselves
    and every pair is verified. In larger ones, where pairs would grow with the
    square, two fingerprints at distance two are both one bit off a common
    value: each lists its value and the 64 one bit away, and is linked with the
    least that lists the same. This gives links for the same components, 65 rows
    a fingerprint at any bucket size. Nothing is left out either way.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("three segments carry at most two errors")
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keys = settle(_keys(prints), "keys")
    shared = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = settle(keys.join(shared, "key"), "met")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = met.where(F.col("n") <= small_bucket)
    pairs = (
        few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (differ <= max_bits)).select("a", "b"))
    crowd = met.where(F.col("n") > small_bucket).select("fp").distinct()
    if max_bits == 1:  # values one bit apart list each other, so the lister of a value links with the value itself
        present = crowd.select(F.col("fp").alias("b"))
        dense = _neighbours(crowd).where("fp != value").select(F.col("fp").alias("a"), F.col("value").alias("b")).join(present, "b", "left_semi")
        return pairs.unionByName(dense.select("a", "b"))
    listed = settle(_neighbours(crowd), "listed")
    least = settle(listed.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    dense = listed.join(least, "value").select(F.col("fp").alias("a"), "b").where(F.col("a") != F.col("b")).where(differ <= max_bits)
    return pairs.unionByName(dense)


def _neighbours(prints: DataFrame) -> DataFrame:
    """Rows (fp, value): the fingerprint itself and the 64 values one bit off."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return prints.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("value"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, fp (bits as a long), group (a fingerprint), component_id.

    Documents of equal or linked fingerprints form a group; ``component_id`` is
    its least id. Whole texts count; documents without words have fingerprint 0
    and are linked like any other. Rows without an id belong to a group but do
    not name it; a group without ids has a missing ``component_id``. Repeated
    rows are repeated. ``key`` tells texts under one id apart. Other columns are
    not read.

    Equal fingerprints are one value in all later steps, so copies never meet in
    pairs; the fingerprint that a third of all documents share is reduced before
    shuffles and split by adaptive execution in the last join.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def printed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = np.array([fingerprint(t, shingle) for t in frame["text"]], "u8")
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "fp": values.view("i8")})

    prints = settle(
        docs.select(as_col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), as_col(text_col).alias("text"))
        .mapInPandas(printed, f"doc_id {id_type}, key long, fp long"), "prints")
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = settle(
        connected_components(fingerprint_links(classes.select("fp"), max_bits), "a", "b").withColumnsRenamed({"node": "fp"}), "roots")
    named = settle(
        classes.join(roots, "fp").groupBy("root").agg(F.min("first_id").alias("linked_id")), "named")
    grouped = settle(
        classes.join(roots.join(named, "root"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("group"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("linked_id")).alias("component_id")),
        "grouped")
    return prints.join(grouped, "fp").select("doc_id", "key", "fp", "group", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each group of :func:`simhash_groups`: that with the least id.

    Rows without an id stay only where their group has no ids. Of rows alike in
    id and text one stays. All columns are kept as they are.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, max_bits)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    marks, wanted = fresh_names(docs, "row_mark", "id_mark"), fresh_names(docs, "row_wanted", "id_wanted")
    keep = settle(best.select(F.col("best.key").alias(wanted[0]), F.xxhash64("best.doc_id").alias(wanted[1])), "keep")
    marked = docs.withColumns({marks[0]: row_key(id_col, text_col), marks[1]: F.xxhash64(as_col(id_col))})
    same = (marked[marks[0]] == keep[wanted[0]]) & (marked[marks[1]] == keep[wanted[1]])
    return marked.join(keep, same, "left_semi").dropDuplicates(marks).drop(*marks)
