"""Benchmark passages in documents, by Wu-Manber search over words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import ascii_lower, fresh_names
from capital_access.session import settle

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (A to Z lower-cased) and all characters beyond ASCII."""
    return _WORD.findall(ascii_lower(text))


def windows_of(words: Sequence[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Every ``width`` consecutive words, or all words of a shorter text; none of no words."""
    return [tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))] if words else []


class WindowSearch:
    """Wu-Manber tables over windows of one length.

    A block is two words (one for windows of a single word). ``shift`` says how
    far the search may move when a block ends at the present word: to where the
    block stands last in some window, or past all of it. At shift 0 the bucket
    of windows that end in this block is compared word by word.
    """

    def __init__(self, windows: dict[tuple[bytes, ...], frozenset[str]]):
        self.width = len(next(iter(windows)))
        self.block = min(2, self.width)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], frozenset[str]]] = {}
        for window, items in windows.items():
            for end in range(self.block, self.width + 1):
                block = window[end - self.block:end]
                self.shift[block] = min(self.width - end, self.shift.get(block, self.width))
            self.buckets.setdefault(window[-self.block:], {})[window] = items

    def find(self, words: Sequence[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """(first word, items) of every occurrence."""
        width, block, shift = self.width, self.block, self.shift
        past = width - block + 1  # no window holds the block
        end, n = width, len(words)
        while end <= n:
            last = tuple(words[end - block:end])
            move = shift.get(last, past)
            if move == 0:
                items = self.buckets[last].get(tuple(words[end - width:end]))
                if items is not None:
                    yield end - width, items
                move = 1
            end += move


def build_searches(items: Sequence[tuple[str, str | None]], width: int) -> list[WindowSearch]:
    """One search for each length of window among (item id, text) rows."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        for window in windows_of(words_of(text), width):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add(item)
    return [WindowSearch({w: frozenset(i) for w, i in found.items()}) for _, found in sorted(by_length.items())]


def hits_in(text: str | None, searches: Sequence[WindowSearch]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged (first, end) stretches of hit words, and the items that occur."""
    words, stretches, items = words_of(text), [], set()
    for search in searches:
        for first, found in search.find(words):
            stretches.append((first, first + search.width))
            items |= found
    return len(words), merged(stretches), items


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of at most ``block_chars`` characters (or one item), one after another."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(as_col(id_col).cast("string"), F.lit("")), as_col(text_col))
    for item, text in rows.toLocalIterator():
        if block and size + len(text or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", width: int = 13, block_chars: int = 4_000_000) -> tuple[DataFrame, str]:
    """``docs`` with a column of hits, and that column's name: n_words, n_hit, n_items, items.

    The benchmark is the stated query set. It is searched for in blocks of at
    most ``block_chars`` characters, or one item: a block's tables go to every
    task (some hundred bytes a character at most). The driver reads the
    benchmark partition by partition and holds two blocks at most.

    A benchmark of one block is one pass over the texts, and nothing is shuffled.
    One of several blocks is a pass, and a job, for each: the hits of a block, a
    row for each distinct text that has any, are written before the next block's
    tables are built, and are joined to the documents by the digest of the text.
    An item occurring in a third of all documents costs no more than another.
    """
    spark = docs.sparkSession
    hits, = fresh_names(docs, "hits")
    shape = "struct<n_words:long,stretches:array<struct<first:int,end:int>>,items:array<string>>"

    def finder(shared):
        @F.pandas_udf(shape)
        def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            searches = build_searches(shared.value, width)
            for texts in batches:
                rows = [hits_in(t, searches) for t in texts]
                yield pd.DataFrame({"n_words": [r[0] for r in rows],
                                    "stretches": [[{"first": a, "end": b} for a, b in r[1]] for r in rows],
                                    "items": [sorted(r[2]) for r in rows]})
        return search

    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return docs.withColumn(hits, finder(spark.sparkContext.broadcast(block))(as_col(text_col))), hits

    digest, own, found = fresh_names(docs, "digest", "own", "found")
    key = F.sha2(as_col(text_col), 256).alias(digest)
    parts = []
    for block in chain([block, following], blocks):
        shared = spark.sparkContext.broadcast(block)
        searched = docs.select(key, finder(shared)(as_col(text_col)).alias(found)).where(F.size(f"{found}.items") > 0)
        parts.append(settle(searched.dropDuplicates([digest]), "benchmark_hits"))
        shared.unpersist()
    lists = [F.flatten(F.collect_list(f"{found}.{c}")).alias(c) for c in ("stretches", "items")]
    joined = reduce(DataFrame.unionByName, parts).groupBy(digest).agg(*lists)
    joined = joined.select(digest, F.struct("stretches", F.array_distinct("items").alias("items")).alias(found))
    counted = docs.withColumn(own, finder(spark.sparkContext.broadcast([]))(as_col(text_col))).withColumn(digest, key)
    both = F.struct(F.col(f"{own}.n_words").alias("n_words"), *(F.coalesce(f"{found}.{c}", f"{own}.{c}").alias(c) for c in ("stretches", "items")))
    return counted.join(joined, digest, "left").withColumn(hits, both).select(*map(as_col, docs.columns), hits), hits


def _n_hit(stretches: Column) -> Column:
    """Words in the union of the stretches: each adds what lies beyond all before it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        F.array_sort(stretches), start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], acc["upto"]))).alias("n"),
                                F.greatest(s["end"], acc["upto"]).alias("upto")),
        lambda acc: acc["n"]).cast("long")


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", width: int = 13, block_chars: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items, contaminated.

    ``items`` holds the ids (as strings, sorted) of the benchmark items of which
    a window of ``width`` words occurs; a shorter item is one window. A word in
    any occurrence is hit. Missing and empty texts have no words and no hits;
    items without words occur nowhere; an item without an id is listed as "".
    Repeated rows are repeated, repeated items count once. Other columns are not
    read.
    """
    found, hits = benchmark_hits(docs.select(as_col(id_col).alias("doc_id"), as_col(text_col).alias("text")), benchmark, "text",
                                 item_col, item_text_col, width, block_chars)
    n_hit = _n_hit(F.col(f"{hits}.stretches"))
    return (
        found.select("doc_id", F.col(f"{hits}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.array_sort(f"{hits}.items").alias("items"))
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      width: int = 13, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    found, hits = benchmark_hits(docs, benchmark, text_col, item_col, item_text_col, width, block_chars)
    bad = contaminated(_n_hit(F.col(f"{hits}.stretches")), F.col(f"{hits}.n_words"))
    return found.where(~bad).drop(hits)
