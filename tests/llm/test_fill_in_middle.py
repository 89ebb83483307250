"""Fill-in-the-middle against cutting and joining strings, and back again."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from capital_access.llm import fill_in_middle as m
from capital_access.llm.queries import op11


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, mid, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(mid), f"<S>{s}<P>{p}<M>{mid}"
    return n, "psm", len(p), len(mid), f"<P>{p}<S>{s}<M>{mid}"


def test_equals_joined_strings_and_goes_back():
    rng = random.Random(3)
    pieces = ["a", "é", "漢字", "\n", "\n\n", "<", "<P", "S>", "<M", " ", "\r\n", " ", "😀", "<<", "P>"]
    forms = set()
    for doc_id in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(0, 14)))
        for rate, spm in ((100, 50), (40, 10)):
            rule = m.FimRule(rate=rate, spm=spm)
            made = m.transform(text, str(doc_id), rule)
            assert made == brute(doc_id, text, rate, spm)
            assert m.restore(made[4], made[1], rule) == text
            forms.add(made[1])
    assert forms == {"plain", "psm", "spm"}


def test_rotation():
    for n in range(9):
        for start in range(n + 1):
            for cut in range(start, n + 1):
                for end in range(cut, n + 1):
                    data = bytes(range(n))
                    buffer = bytearray(data)
                    m.rotate(buffer, start, cut, end)
                    assert bytes(buffer) == data[:start] + data[cut:end] + data[start:cut] + data[end:]
                    m.rotate(buffer, start, start + end - cut, end)
                    assert bytes(buffer) == data


def test_other_marks():
    rule = m.FimRule(prefix="<|fim_prefix|>", suffix="<|fim_suffix|>", middle="<|fim_middle|>")
    for doc_id in range(50):
        made = m.transform("one <|fim\ntwo\nthree <", str(doc_id), rule)
        assert made[1] != "plain" and m.restore(made[4], made[1], rule) == "one <|fim\ntwo\nthree <"
    for marks in (("", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P>", "<P>x", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            m.FimRule(*marks)


def test_rows(spark, docs):
    long = "".join(f"line {k} é\n" for k in range(300_000))
    pairs = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, ""), (4, "\n\n\n"), (None, "x\ny"), (5, "has <M> inside\nx"), (6, long), (7, "one line")]
    df = docs(pairs).withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y"), "key": F.lit(2)})
    made = m.fill_in_middle(df)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("restored", m.restored()).collect()
    assert [tuple(r)[1:6] for r in rows] == [brute(i, t) for i, t in pairs]
    assert [r["restored"] for r in rows] == [t or "" for _, t in pairs]
    assert rows[0] == rows[1]
    assert m.fill_in_middle(docs([])).collect() == []
    text_ids = spark.createDataFrame([("a", "x\ny")], "doc_id string, text string")
    assert m.fill_in_middle(text_ids).first()["output"] == brute("a", "x\ny")[4]


def test_whole_table(spark, small):
    found = {r["doc_id"]: r for r in op11(spark, "/root/testdata/sf0.001").collect()}
    given = small("documents").collect()
    assert len(found) == len(given)
    for row in given:
        n, form, before, between, output = brute(row["doc_id"], row["text"])
        r = found[row["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, before, between)
        assert r["output_sha256"] == sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == sha256((row["text"] or "").encode()).hexdigest()
