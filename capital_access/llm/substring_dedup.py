"""Removal of repeated passages, by runs of consecutive pieces of sentences that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import row_key, small_batches
from capital_access.session import settle


@dataclass(frozen=True)
class SpanRule:
    """What counts as a passage.

    A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line
    end. One of ``longest`` words or more is cut into pieces of at most that
    many: behind the word of the least checksum, the last of equals, of every
    ``longest`` consecutive words. So a cut depends on words less than
    ``longest`` away from it, and two occurrences of a passage are cut alike
    but for at most ``2 * longest - 1`` words at either end, whatever stands
    around them.

    A run is ``sentences`` consecutive pieces, or as many more as hold
    ``least_words`` words: shorter phrases repeat by chance. Each piece begins a
    run and ends one, so a repeated passage is covered up to its first and last
    common cut. Of 51 words at least 22 lie between these, in three pieces or
    more: a run, wherever the passage begins and ends. A document of fewer
    pieces is one run if it has the words.
    """

    sentences: int = 3
    longest: int = 8
    least_words: int = 20


#: White space by code point; beyond the last one of the table there is none.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def _word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts, whether it is the last of its sentence, and where what follows such a word starts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _SPACES[np.minimum(codes, len(_SPACES) - 1)]
    edges = np.flatnonzero(space[1:] != space[:-1])  # where a word starts and ends, in turn
    starts, ends = edges[::2], edges[1::2]
    closing = codes[ends - 1]
    last = (closing == ord(".")) | (closing == ord("!")) | (closing == ord("?"))
    follow = np.append(starts[1:], len(codes))
    lines = np.flatnonzero(codes == 10)
    if len(lines):
        # Without a full stop, a sentence ends behind the first line feeds of the gap.
        behind = lines[np.append(np.flatnonzero(np.diff(lines) != 1), len(lines) - 1)] + 1
        first = np.searchsorted(lines, ends)
        there = lines[np.minimum(first, len(lines) - 1)]
        broken = ~last & (first < len(lines)) & (there < follow)
        follow[broken] = behind[np.searchsorted(behind, there[broken], "right")]
        last |= broken
    if len(last):
        last[-1], follow[-1] = True, len(codes)
    return starts, last, follow


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    return np.minimum(values[:len(values) - (width - done)], values[width - done:])


def _pieces(text: str, rule: SpanRule) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where each piece ends in the text, its number of words, and all words in lower case with a blank between any two."""
    starts, last, follow = _word_places(text)
    words, n, width = " ".join(text.lower().split()).encode("utf-8", "surrogatepass"), len(starts), rule.longest
    ends = last.copy()
    if n >= width:
        # The least checksum of each window within a sentence, the last of equals.
        ranked = np.fromiter(map(crc32, words.split(b" ")), "i8", n) * n + np.arange(n - 1, -1, -1)
        sentence = np.cumsum(last) - last
        inside = sentence[:n - width + 1] == sentence[width - 1:]
        ends[n - 1 - _least(ranked, width)[inside] % n] = True
    at = np.flatnonzero(ends)
    return np.where(last[at], follow[at], np.append(starts[1:], len(text))[at]), np.diff(at, prepend=-1), words


def sentence_bounds(text: str, rule: SpanRule) -> list[tuple[int, int, int]]:
    """(start, end, words) of each piece; white space behind a piece belongs to it."""
    ends, counts, _ = _pieces(text, rule)
    ends = ends.tolist()
    return list(zip([0, *ends[:-1]], ends, counts.tolist()))


def _runs(words: np.ndarray, sizes: np.ndarray, rule: SpanRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first piece, and piece behind the last, of all runs, given the words of the pieces of documents side by side.

    ``sizes`` has the number of pieces of each document. Pieces are numbered through all documents.
    """
    n, ends = len(words), np.cumsum(sizes, dtype="i8")
    starts, before, place = ends - sizes, np.concatenate([[0], np.cumsum(words, dtype="i8")]), np.arange(n)
    of = np.repeat(np.arange(len(sizes)), sizes)
    last = np.maximum(place + rule.sentences, np.searchsorted(before, before[:-1] + rule.least_words))
    first = np.minimum(place + 1 - rule.sentences, np.searchsorted(before, before[1:] - rule.least_words, "right") - 1)
    begun, ended = last <= ends[of], first >= starts[of]
    ended[ended] = last[first[ended]] != place[ended] + 1  # else the same run as the one that begins there
    short = np.flatnonzero((sizes > 0) & (sizes < rule.sentences) & (before[ends] - before[starts] >= rule.least_words))
    return (np.concatenate([of[begun], of[ended], short]), np.concatenate([place[begun], first[ended], starts[short]]),
            np.concatenate([last[begun], place[ended] + 1, ends[short]]))


def run_bounds(words: list[int], rule: SpanRule) -> list[tuple[int, int]]:
    """(first piece, number of pieces) of all runs of a document, given the words of its pieces."""
    _, first, last = _runs(np.array(words, "i8"), np.array([len(words)]), rule)
    return sorted(zip(first.tolist(), (last - first).tolist()))


def pieces_of(text: str | None, rule: SpanRule) -> tuple[bytes, bytes]:
    """Numbers of words (16 bits each) and hashes (64 bits each) of the pieces; case and white space do not count."""
    _, counts, words = _pieces(text or "", rule)
    blanks = np.append(np.flatnonzero(np.frombuffer(words, "u1") == ord(" ")), len(words))
    ends = blanks[np.cumsum(counts) - 1]
    digests = [xxhash.xxh3_64_digest(words[a:b]) for a, b in zip([0, *(ends + 1).tolist()], ends.tolist())]
    return counts.astype("<u2").tobytes(), b"".join(digests)


#: More than the pieces of any run.
_LENGTHS = 1 << 31

#: Odd numbers, so that they have inverses modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of the bases and of their inverses, modulo 2 ** 64, as far as needed."""

    def __init__(self) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.tables or len(self.tables[0][0]) < n:
            size = max(1024, 2 * n)
            self.tables = [tuple(np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(size - 1, factor, "u8"), dtype="u8")])
                                 for factor in (base, pow(base, -1, 1 << 64))) for base in _BASES]
        return self.tables


_powers = _Powers()


def _summed(pieces: np.ndarray, first: np.ndarray, last: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    rising, falling = powers
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(pieces * rising[:len(pieces)], dtype="u8")])
    return (sums[last] - sums[first]) * falling[first] + (last - first).astype("u8")


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of 64 and (if ``both``) of 32 bits of the runs of pieces ``first`` to before ``last``.

    A run's hash is the sum of its pieces' hashes times rising powers, which is
    a difference of two running sums; so all runs cost one sweep. It does not
    depend on what stands before the run: documents may lie side by side.
    """
    one, two = _powers.upto(len(hashes) + 1)
    h1 = _summed(hashes, first, last, one).view("i8")
    if not both:
        return h1, None
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_BASES[0])
    return h1, (_summed(mixed, first, last, two) >> np.uint64(32)).astype("u4").view("i4")


def without(text: str, runs: list[tuple[int, int]], rule: SpanRule) -> tuple[str, int, str]:
    """The text without the pieces of ``runs``; pieces removed, spans removed."""
    pieces = sentence_bounds(text, rule)
    gone = sorted({k for first, n in runs for k in range(first, first + n)})
    spans: list[list[int]] = []
    for k in gone:
        a, b, _ = pieces[k]
        if spans and spans[-1][1] == a:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), len(gone), ",".join(f"{a}:{b}" for a, b in spans)


def cut_documents(docs: DataFrame, id_col: str, text_col: str, rule: SpanRule) -> DataFrame:
    """Rows doc_id, key, row, words, hashes: the pieces of every document; ``row`` numbers the rows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames):
            made = pd.DataFrame([pieces_of(text, rule) for text in frame["text"]], columns=["words", "hashes"], index=frame.index)
            yield made.assign(doc_id=frame["doc_id"], key=frame["key"])[["doc_id", "key", "words", "hashes"]]

    return docs.select(as_col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), as_col(text_col).alias("text")).mapInPandas(
        cut, f"doc_id {id_type}, key long, words binary, hashes binary").withColumn("row", F.monotonically_increasing_id())


def passage_runs(pieces: DataFrame, rule: SpanRule, whole: bool) -> DataFrame:
    """Rows h1 (and, if ``whole``, h2, row, first) for every run of every document that has been cut; h2 holds the run's length too."""
    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames):
            sizes = np.fromiter(map(len, frame["words"]), "i8", len(frame)) // 2
            of, first, last = _runs(np.frombuffer(b"".join(frame["words"]), "<u2"), sizes, rule)
            if not len(of):
                continue
            h1, h2 = run_hashes(np.frombuffer(b"".join(frame["hashes"]), ">u8").astype("u8"), first, last, whole)
            made = {"h1": h1}
            if whole:
                made |= {"h2": h2.astype("i8") * _LENGTHS + last - first, "row": frame["row"].to_numpy()[of],
                         "first": (first - (np.cumsum(sizes) - sizes)[of]).astype("i4")}
            yield pd.DataFrame(made)

    return pieces.select("row", "words", "hashes").mapInPandas(runs, "h1 long, h2 long, row long, first int" if whole else "h1 long")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: SpanRule = SpanRule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, n_removed, removed_spans, text.

    ``text`` lacks every piece that lies in a repeat of a run; the first
    occurrence, by id (missing ids first) and place, stays. ``removed_spans``
    lists start:end in code points of the given text, comma-joined.

    Rows alike in id and text are one document: they get the same result, and do
    not count as repeats of each other. A passage repeated within a document
    goes too, but for its first occurrence. Empty texts stay empty, missing ones
    missing, with no pieces. Texts of any length are cut whole, one at a time.
    Other columns are not read.

    The pieces of every document are written once, as eight bytes of hash and two
    of length each; runs are sums over them. Which runs repeat is found from one
    part of their hash, in an aggregate reduced before its shuffle; only the runs
    whose part repeats, about one in twenty, are then compared by both parts (96
    bits). The joins that look up their occurrences can split a passage that a
    third of all documents share. Only places travel; each text is moved once,
    to meet its places, and only texts that lose something are cut again.
    """
    cut = settle(cut_documents(docs, id_col, text_col, rule), "pieces")
    # Written, as only a join of plain tables can split a hash that has a third of all runs.
    halves = settle(passage_runs(cut, rule, False).groupBy("h1").agg(F.count("*").alias("times")).where("times > 1").select("h1"), "halves")
    likely = settle(passage_runs(cut, rule, True).join(halves, "h1", "left_semi"), "likely")
    found = settle(likely.join(cut.select("row", "doc_id", "key"), "row").drop("row"), "found")
    repeated = settle(
        found.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "key", "first")).alias("origin"))
        .where("times > 1").drop("times"), "repeated")
    again = found.join(repeated, ["h1", "h2"]).where("NOT struct(doc_id, key, first) <=> origin").select(
        "doc_id", "key", "first", F.pmod("h2", F.lit(_LENGTHS)).cast("int").alias("n"))
    counted = cut.select("doc_id", "key", (F.octet_length("words") / 2).cast("int").alias("first"), F.lit(0).alias("n"))
    places = settle(
        again.unionByName(counted).groupBy("doc_id", "key").agg(
            F.collect_set(F.when(F.col("n") > 0, F.struct("first", "n"))).alias("again"), F.max(F.when(F.col("n") == 0, F.col("first"))).alias("n_pieces"))
        .withColumnsRenamed({"doc_id": "of_id", "key": "of_key"}), "places")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cleaned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames):
            rows = [
                (text, 0, "") if text is None or not len(again) else without(text, [(r["first"], r["n"]) for r in again], rule)
                for text, again in zip(frame["text"], frame["again"])
            ]
            made = pd.DataFrame(rows, columns=["text", "n_removed", "removed_spans"], index=frame.index)
            yield made.assign(doc_id=frame["doc_id"], n_pieces=frame["n_pieces"])[["doc_id", "n_pieces", "n_removed", "removed_spans", "text"]]

    return (
        docs.select(as_col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), as_col(text_col).alias("text"))
        .join(places, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left").select("doc_id", "text", "again", "n_pieces")
        .mapInPandas(cleaned, f"doc_id {id_type}, n_pieces long, n_removed long, removed_spans string, text string"))
