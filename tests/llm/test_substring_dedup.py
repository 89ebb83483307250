"""Repeated passages against a dictionary of all runs."""

import random
import re
from zlib import crc32

from capital_access.llm.substring_dedup import SpanRule, remove_repeated_passages, run_bounds, sentence_bounds

PASSAGE = "Alpha beta gamma delta one. Epsilon zeta eta theta two. Iota kappa lambda mu three. Nu xi omicron pi four."


def every_run(words, rule):
    """Runs that are just long enough from their first piece on, or up to their last."""
    found, n = [], len(words)
    for first in range(n):
        for last in range(first + 1, n + 1):
            def long(a, b):
                return b - a >= min(rule.sentences, n) and sum(words[a:b]) >= rule.least_words
            if long(first, last) and not (long(first, last - 1) and long(first + 1, last)):
                found.append((first, last - first))
    return found


def brute(rows, rule):
    """{(id, text): kept text} by going through all documents in the order of their ids."""
    seen, kept = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        if text is None:
            kept[doc_id, text] = None
            continue
        pieces = sentence_bounds(text, rule)
        words, gone = [p[2] for p in pieces], set()
        for first, n in every_run(words, rule):
            run = tuple(" ".join(text[a:b].lower().split()) for a, b, _ in pieces[first:first + n])
            if run in seen:
                gone |= set(range(first, first + n))
            seen.setdefault(run, (doc_id, first))
        kept[doc_id, text] = "".join(text[a:b] for k, (a, b, _) in enumerate(pieces) if k not in gone)
        if not pieces:
            kept[doc_id, text] = text
    return kept


def result(df):
    return {(r.doc_id, r.n_removed): r.text for r in df.collect()}


def test_pieces_cover_the_text():
    text = "One two.  Three!\n\nFour five? " + "a b c d e f g, h, " + "w " * 45 + "end. "
    bounds = sentence_bounds(text, SpanRule())
    assert [text[a:b] for a, b, _ in bounds][:3] == ["One two.  ", "Three!\n\n", "Four five? "]
    assert all(n == len(text[a:b].split()) <= 20 for a, b, n in bounds)
    assert "".join(text[a:b] for a, b, _ in bounds) == text
    assert sentence_bounds("", SpanRule()) == [] and sentence_bounds("  \n ", SpanRule()) == []


def plain_pieces(text, longest):
    """Words of each piece, from the words of each sentence alone: a cut behind the least checksum of some ``longest`` words."""
    pieces = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        words = sentence.split()
        cuts = set()
        for k in range(len(words) - longest + 1):
            window = [(crc32(w.lower().encode()), -j) for j, w in enumerate(words[k:k + longest], k)]
            cuts.add(-min(window)[1])
        piece = []
        for k, word in enumerate(words):
            piece.append(word)
            if k in cuts:
                pieces.append(piece)
                piece = []
        if piece:
            pieces.append(piece)
    return pieces


def test_cuts_equal_plain_ones(small):
    rng = random.Random(6)
    texts = [r["text"] for r in small("documents").select("text").collect()]
    texts += [" ".join(rng.choices(["a", "B.", "c", "d\n", "e!", "E", "é"], k=rng.randrange(0, 60))) for _ in range(300)]
    texts += [" ".join(rng.choices(["x", "y", "z", "w."], k=100_000))]
    for text in texts:
        for longest in (3, 8):
            bounds = sentence_bounds(text, SpanRule(longest=longest))
            assert [text[a:b].split() for a, b, _ in bounds] == plain_pieces(text, longest)
            assert [n for _, _, n in bounds] == [len(text[a:b].split()) for a, b, _ in bounds]


def test_runs_are_long_enough_and_no_longer():
    rng = random.Random(8)
    for _ in range(200):
        rule = SpanRule(sentences=rng.randrange(1, 5), least_words=rng.randrange(1, 20))
        words = [rng.randrange(1, 8) for _ in range(rng.randrange(0, 15))]
        assert run_bounds(words, rule) == sorted(every_run(words, rule))


def test_passage_of_single_words_and_a_changed_word_in_a_long_sentence(docs):
    shouts = " ".join(f"WORD{k}!!" for k in range(60))
    long = [f"term{k}" for k in range(120)]
    changed = [*long[:30], "extra", "words", *long[31:]]
    df = docs([(1, f"Start. {shouts} End."), (2, f"Other start. {shouts}"), (3, " ".join(long)), (4, " ".join(changed))])
    found = {r.doc_id: r for r in remove_repeated_passages(df).collect()}
    assert found[2].text == "Other start. " and found[1].n_removed == found[3].n_removed == 0
    left = found[4].text.split()
    assert "extra" in left and len(left) < 45


def test_later_occurrences_go(docs):
    df = docs([(1, f"Something else. {PASSAGE} And more."), (2, f"A start here. {PASSAGE} An end here."), (3, "Clean text only. With two sentences.")])
    found = {r.doc_id: r for r in remove_repeated_passages(df).collect()}
    assert found[1].n_removed == found[3].n_removed == 0
    assert found[2].text == "A start here. An end here." and found[2].n_removed == 4
    assert found[2].removed_spans == f"14:{14 + len(PASSAGE) + 1}"


def test_long_passage_without_punctuation_inside(docs):
    passage = " ".join(f"word{k}" for k in range(55)) + "."
    df = docs([(5, f"First here. {passage} Tail one."), (6, f"Second there. {passage} Tail two.")])
    found = {r.doc_id: r.text for r in remove_repeated_passages(df).collect()}
    assert passage in found[5] and found[6] == "Second there. Tail two."


def test_repeats_within_a_document_ties_nulls_and_copies(docs):
    df = docs([(1, f"{PASSAGE} {PASSAGE}"), (None, PASSAGE), (None, None), (2, ""), (3, None), (4, " \n"), (7, PASSAGE), (7, PASSAGE), (8, "Short. Of. The."),
               (9, "Short. Of. The."), (7, "Another text under the same id.")])
    rows = sorted(((r.doc_id, r.n_pieces, r.n_removed, r.text) for r in remove_repeated_passages(df).collect()), key=str)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r[1:])
    assert by_id[None] == [(0, 0, None), (4, 0, PASSAGE)]  # missing ids come first
    assert by_id[1] == [(8, 8, "")]
    assert by_id[7].count((4, 4, "")) == 2 and (1, 0, "Another text under the same id.") in by_id[7]
    assert by_id[2] == [(0, 0, "")] and by_id[3] == [(0, 0, None)] and by_id[4] == [(0, 0, " \n")]
    assert by_id[8] == by_id[9] == [(3, 0, "Short. Of. The.")]  # too few words to be a passage


def test_empty_table_and_clashing_columns(spark, docs):
    assert remove_repeated_passages(docs([])).collect() == []
    df = spark.createDataFrame([(1, PASSAGE, 5, 6), (2, PASSAGE, 5, 6)], "doc_id long, text string, key int, again int")
    assert result(remove_repeated_passages(df)) == {(1, 0): PASSAGE, (2, 4): ""}


def test_whole_table_equals_brute_force(small):
    df = small("documents").select("doc_id", "text")
    rule = SpanRule(least_words=6)
    expected = brute([tuple(r) for r in df.collect()], rule)
    made = remove_repeated_passages(df, rule=rule)
    assert {r.doc_id: r.text for r in made.collect()} == {k[0]: v for k, v in expected.items()}
    assert made.where("n_removed > 0").count() > 5


def sentences_around(rng, words, passage):
    """Random sentences of 3 to 30 words; the passage begins and ends within two of them."""
    def some(n):
        return [rng.choice(words) for _ in range(n)]

    before, after = (" ".join(" ".join(some(rng.randrange(3, 31))) + "." for _ in range(3)) for _ in range(2))
    return " ".join([before, *some(rng.randrange(1, 15)), passage, *some(rng.randrange(1, 15))]) + ". " + after


def test_passages_that_begin_and_end_within_sentences(docs):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    passages, rows = {}, []
    for k in range(300):
        count, ends = rng.choice([51, 51, 60, 80, 120]), rng.choice([0, 0.05, 0.1, 0.3])
        passages[k] = " ".join(rng.choice(words) + (rng.choice(".,!?;") if rng.random() < ends else "") for _ in range(count))
        rows += [(i, sentences_around(rng, words, passages[k])) for i in (k, 1000 + k)]
    texts = dict(rows)
    found = {r.doc_id: r for r in remove_repeated_passages(docs(rows)).collect()}
    for k, passage in passages.items():
        assert found[k].n_removed == 0
        at = texts[1000 + k].index(passage)
        spans = [tuple(map(int, s.split(":"))) for s in found[1000 + k].removed_spans.split(",") if s]
        inside = sum(len(texts[1000 + k][max(a, at):min(b, at + len(passage))].split()) for a, b in spans)
        assert inside >= len(passage.split()) - 29  # at most 15 words are left at the beginning, 14 at the end
