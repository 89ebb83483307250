"""Licence notices against comparing every stretch."""

from collections import Counter

from pyspark.sql import functions as F

from capital_access.llm import license_scan as m


def brute(text, templates, least):
    found, bigrams = {}, m.template_bigrams(text or "")
    for k, (licence, template) in enumerate(templates):
        wanted = Counter(m.template_bigrams(template))
        n = sum(wanted.values())
        for at in range(len(bigrams)):
            if bigrams[at] not in wanted:
                continue
            for end in range(at + 1, min(len(bigrams), at + 2 * n) + 1):  # every length, whatever the bounds
                dice = 2 * sum((Counter(bigrams[at:end]) & wanted).values()) / (n + end - at)
                if dice >= least - 1e-9 and dice > found.get(k, (0,))[0] + 1e-12:
                    found[k] = (dice, at)
    return {(templates[k][0], k, round(d, 6), at) for k, (d, at) in found.items()}


def test_equals_every_stretch(docs):
    mit = m.TEMPLATES[5][1]
    texts = {1: f"Foo bar. {m.TEMPLATES[0][1]} Baz", 2: f"{mit}", 3: mit.replace("free of charge", "gratis").upper() + " tail of the text",
             4: "Licensed under the Apache License, Version 1.1. Released under the MIT-License! This work is licensed under the GNU General Public License, version 3",
             5: "of the of the of the " * 400, 6: "", 7: "word", 8: None, 9: "x " * 300 + m.TEMPLATES[8][1] + " " + m.TEMPLATES[8][1]}
    rows = m.scan_licences(docs([*texts.items(), (9, texts[9])])).collect()
    for i, text in texts.items():
        assert {(r.licence, r.template, r.dice, r.first_word) for r in rows if r.doc_id == i} == brute(text, m.TEMPLATES, 0.8)
    assert [r.n_windows for r in rows if r.doc_id == 9 and r.template == 8] and len({(r.doc_id, r.template) for r in rows}) == len(rows)


def test_notices_with_inserted_words(docs):
    texts = {}
    for k, (_, template) in enumerate(m.TEMPLATES):
        words, n = template.split(), len(m.template_bigrams(template))
        for share in (15, 25, 35):
            extra = [f"extra{j}" for j in range(n * share // 100)]
            half = len(words) // 2
            texts[100 * k + share] = "before it " + " ".join([*words[:half], *extra, *words[half:]]) + " behind it"
    rows = {(r.doc_id, r.template): r for r in m.scan_licences(docs([*texts.items()])).collect()}
    found = 0
    for i, text in texts.items():
        k = i // 100
        wanted, own = Counter(m.template_bigrams(m.TEMPLATES[k][1])), m.template_bigrams(text)[2:-2]
        whole = 2 * sum((Counter(own) & wanted).values()) / (sum(wanted.values()) + len(own))
        if whole >= 0.8:
            assert rows[i, k].dice >= round(whole, 6) - 1e-6
            found += 1
    assert found > 40


def test_edges(spark, docs):
    assert m.scan_licences(docs([])).collect() == []
    df = docs([(None, m.TEMPLATES[0][1]), (1, m.TEMPLATES[3][1])]).withColumns({"w": F.lit(1), "known": F.lit(2), "key": F.lit(3), "n": F.lit(4)})
    assert sorted({(r.doc_id, r.licence) for r in m.scan_licences(df).collect()}, key=str) == [(1, "MIT"), (None, "Apache-2.0")]
    plan = m.scan_licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
