"""Secrets in texts: known shapes, and stretches of high entropy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import fresh_names

Span = tuple[str, int, int]

#: Base kinds in the order in which spans that start together are listed: pattern, group whose length counts, least length.
BASE_KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs are whole either way; the bound here spares the short ones
}
ENTROPY_KIND = "entropy"
_ORDER = {kind: k for k, kind in enumerate([*BASE_KINDS, ENTROPY_KIND])}

#: Strings of high entropy that are no secrets.
ALLOWED = tuple(re.compile(p) for p in (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    r"[0-9+=_/-]+",  # numbers, dates, rules
    r"(?i)sha(?:1|256|384|512)-[A-Za-z0-9+/=]+",  # published digests
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",  # the access key of public documentation
))
#: Words that mark a path segment as made up.
_MADE_UP = re.compile("EXAMPLE|example|placeholder|PLACEHOLDER")


@dataclass(frozen=True)
class EntropyRule:
    """Least Shannon entropy, in bits a character, of ``window`` characters, by the class they are of.

    The class of a window is the narrowest that holds it: ``hex`` (digits and a
    to f of one case), ``alnum`` (digits and letters of one case), ``mixed``
    (digits and letters of both cases, with or without signs), ``letters``
    (letters alone, at least a quarter of them of either case, which names in
    camel case hardly have). Other windows without a digit or without a letter
    are words, paths or numbers and have no class.
    """

    window: int = 20
    hex: float = 3.0
    alnum: float = 3.5
    mixed: float = 3.8
    letters: float = 3.8


_LOWER_HEX, _UPPER_HEX = frozenset("abcdef"), frozenset("ABCDEF")


def _kinds(ch: str) -> tuple[int, int, int, int, int, int]:
    """Digit, lower case, upper case, lower or upper case beyond hex, sign."""
    lower, upper = ch.islower(), ch.isupper()
    return (ch.isdigit(), lower, upper, lower and ch not in _LOWER_HEX, upper and ch not in _UPPER_HEX, not ch.isalnum())


_KINDS = {chr(k): _kinds(chr(k)) for k in range(128)}


def entropy_spans(candidate: str, rule: EntropyRule) -> list[tuple[int, int]]:
    """(start, end) of the stretches covered by windows of at least their class's entropy.

    Counts of characters and classes are kept while the window slides: a step
    takes one character out and one in, whatever the window's width.
    """
    width = rule.window
    term = [0.0] + [c * log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    digits = lowers = uppers = low_beyond = up_beyond = signs = 0
    total, found = 0.0, []
    for at, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        d, lo, up, lb, ub, sg = _KINDS[ch]
        digits += d; lowers += lo; uppers += up; low_beyond += lb; up_beyond += ub; signs += sg  # noqa: E702
        if at >= width:
            old = candidate[at - width]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
            d, lo, up, lb, ub, sg = _KINDS[old]
            digits -= d; lowers -= lo; uppers -= up; low_beyond -= lb; up_beyond -= ub; signs -= sg  # noqa: E702
        if at < width - 1:
            continue
        if not digits:
            if signs or 4 * min(lowers, uppers) < width:
                continue
            least = rule.letters
        elif not lowers + uppers:
            continue
        elif lowers and uppers or signs:
            least = rule.mixed
        else:
            least = rule.alnum if low_beyond + up_beyond else rule.hex
        if log2(width) - total / width >= least - 1e-9:
            start = at - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((start, at + 1))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the known shapes: leftmost and non-overlapping within a kind, matches that are too short dropped."""
    return [(kind, m.start(), m.end()) for kind, (pattern, group, least) in BASE_KINDS.items()
            for m in pattern.finditer(text) if len(m[group]) >= least]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def stretches(candidate: str, rule: EntropyRule) -> list[tuple[int, str]]:
    """(start, stretch) of what is left of a candidate without its made-up path segments."""
    if not _MADE_UP.search(candidate):
        return [(0, candidate)]
    found, begin, at = [], 0, 0
    for segment in candidate.split("/"):
        end = at + len(segment)
        if len(segment) <= 2 * rule.window and _MADE_UP.search(segment):
            found.append((begin, candidate[begin:max(begin, at - 1)]))
            begin = end + 1
        at = end + 1
    return [(k, s) for k, s in [*found, (begin, candidate[begin:])] if len(s) >= rule.window]


def secret_spans(text: str | None, rule: EntropyRule = EntropyRule()) -> list[Span]:
    """(kind, start, end) of every secret, in code points, by start and kind.

    An entropy span is added where it lies in no span of a known shape and is
    not on the allow-list, by itself or with the whole candidate it lies in. A
    path segment of at most two windows that holds a word such as "example" is
    no part of any span; what stands before and behind it is searched by itself,
    and a longer segment is searched like any other.
    """
    if not text:
        return []
    spans = base_spans(text)
    known = list(spans)
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{rule.window},}}", text):
        if any(p.fullmatch(m[0]) for p in ALLOWED):
            continue
        windows = [(m.start() + first, span) for first, stretch in stretches(m[0], rule) for span in entropy_spans(stretch, rule)]
        for first, (a, b) in windows:
            start, end = first + a, first + b
            if not any(s <= start and end <= e for _, s, e in known) and not any(p.fullmatch(text[start:end]) for p in ALLOWED):
                spans.append((ENTROPY_KIND, start, end))
    return in_order(spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str | None, rule: EntropyRule = EntropyRule(), mark: str = "[SECRET]") -> str | None:
    """The text with ``mark`` in the place of every stretch covered by spans."""
    merged: list[list[int]] = []
    for _, start, end in secret_spans(text, rule):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    if not merged:
        return text
    kept, at = [], 0
    for start, end in merged:
        kept += [text[at:start], mark]
        at = end
    return "".join([*kept, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    ``spans`` lists kind:start:end of all spans, comma-joined; ``base_sha256``
    is the SHA-256 of the same list without the entropy spans. Missing and empty
    texts have none. Repeated rows are repeated; a missing id stays missing; no
    column but id and text is read. One pass over the texts, no shuffle.
    """
    shape = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"

    @F.pandas_udf(shape)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = secret_spans(text, rule)
                kinds = [s[0] for s in spans]
                base = listed([s for s in spans if s[0] != ENTROPY_KIND])
                rows.append((*map(kinds.count, _ORDER), sha256(base.encode()).hexdigest(), listed(spans)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])

    return docs.select(as_col(id_col).alias("doc_id"), scanned(as_col(text_col)).alias("found")).select("doc_id", "found.*")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """``docs`` with every secret replaced by a mark; rows without one stay exactly as they are.

    ``length_col``, if the table has it, is set anew where the text has changed.
    """
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: redacted(t, rule))

    text, = fresh_names(docs, "clean_text")
    out = docs.withColumn(text, clean(as_col(text_col)))
    changes = {}
    if length_col in docs.columns:
        changes[length_col] = F.when(F.col(text).eqNullSafe(as_col(text_col)), as_col(length_col)).otherwise(
            F.length(text).cast(docs.schema[length_col].dataType))
    return out.withColumns(changes | {text_col: F.col(text)}).select(*map(as_col, docs.columns))
