"""Fill-in-the-middle training texts, by block rotation inside a byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import small_batches

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FimRule:
    """Marks, seed and shares (in percent) of the transformation.

    ``rate`` percent of the documents are cut, of these ``spm`` percent into the
    order suffix, prefix, middle, the others into prefix, suffix, middle. Each mark
    is one character that occurs nowhere else in the marks, and more behind it;
    so a mark never arises where a text meets a mark, and the first one found is
    the one that was inserted.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate: int = 100
    spm: int = 50

    def __post_init__(self) -> None:
        marks = self.marks
        if not all(marks) or len({m[0] for m in marks}) != 1 or any(m.startswith(o) for m in marks for o in marks if o is not m) \
                or any(m.count(m[0]) != 1 for m in marks):
            raise ValueError(f"marks must begin with one and the same character, hold it once, and not begin one another: {self.marks}")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: str | None, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the digest of seed and id; a missing id is the text ``null``."""
    digest = sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k:8 * k + 8], 16) for k in range(4))


def line_ends(data: bytes) -> np.ndarray:
    """Where each line ends, its line feed included; the last line may lack one."""
    ends = np.flatnonzero(np.frombuffer(data, "u1") == 10) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks start..cut and cut..end in place: reverse each, then both together."""
    view = np.frombuffer(buffer, "u1")
    for a, b in ((start, cut), (cut, end), (start, end)):
        half = (b - a) // 2
        left, right = view[a:a + half], view[b - half:b][::-1]
        kept = left.copy()
        left[:] = right
        right[:] = kept


def transform(text: str | None, doc_id: str | None, rule: FimRule) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, characters of the prefix, of the middle, output)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = line_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, rule.seed)
    marks = [m.encode() for m in rule.marks]
    if not data or h3 % 100 >= rule.rate or any(m in data for m in marks):
        return n, PLAIN, None, None, text or ""
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    before, between = len(data[:a].decode("utf-8", "surrogatepass")), len(data[a:b].decode("utf-8", "surrogatepass"))
    buffer = bytearray(data)
    buffer[b:b] = marks[1]
    buffer[a:a] = marks[2]
    buffer[0:0] = marks[0]
    a, b = a + len(marks[0]), b + len(marks[0]) + len(marks[2])
    form = SPM if h4 % 100 < rule.spm else PSM
    # Prefix, middle and suffix, each behind its mark: the suffix goes before the middle, or before both.
    rotate(buffer, 0 if form == SPM else a, b, len(buffer))
    return n, form, before, between, buffer.decode("utf-8", "surrogatepass")


def restore(output: str, form: str, rule: FimRule) -> str:
    """The text of an output, by the inverse rotation; only the marks tell where the cuts were."""
    if form == PLAIN:
        return output
    buffer = bytearray(output.encode("utf-8", "surrogatepass"))
    prefix, suffix, middle = (m.encode() for m in rule.marks)
    first = buffer.find(suffix)
    second = buffer.find(prefix if form == SPM else middle, first)
    rotate(buffer, first, second, len(buffer))
    a = buffer.find(middle)
    b = buffer.find(suffix, a)
    del buffer[b:b + len(suffix)], buffer[a:a + len(middle)], buffer[:len(prefix)]
    return buffer.decode("utf-8", "surrogatepass")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: FimRule = FimRule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    A text of n lines (a line ends behind its line feed, or with the text) is cut
    at two of its n + 1 line ends, drawn from a digest of seed and id: rows alike
    in id and text get the same output, whatever the partitioning. ``output``
    holds the three parts behind their marks, in the order of ``form`` (``psm``
    or ``spm``). Empty and missing texts, texts that hold a mark, and those
    beyond ``rate`` are ``plain``: output is the text (a missing one is empty),
    and the lengths are missing. Equal cuts leave parts empty. A missing id draws
    as the text ``null``. An empty table stays empty; other columns are not read.

    Every row is made alone, so nothing is shuffled. Cuts are found by a scan
    for line feeds, and the parts change places inside one buffer: besides
    it, a rotation holds at most half of what it moves, so that a text of any
    length takes a small multiple of its bytes.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames):
            rows = [transform(text, key, rule) for key, text in zip(frame["key"], frame["text"])]
            found = pd.DataFrame(rows, columns=made, index=frame.index)
            for name in ("prefix_chars", "middle_chars"):
                found[name] = found[name].astype("Int64")
            yield found.assign(doc_id=frame["doc_id"])[["doc_id", *made]]

    return docs.select(as_col(id_col).alias("doc_id"), as_col(id_col).cast("string").alias("key"), as_col(text_col).alias("text")).mapInPandas(
        cut, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output_col: str = "output", form_col: str = "form", rule: FimRule = FimRule()) -> Column:
    """The exact texts of outputs, from output and form alone; a missing output stays missing."""

    @F.pandas_udf("string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([None if o is None else restore(o, f, rule) for o, f in zip(outputs, forms)])

    return back(as_col(output_col), as_col(form_col))
