"""Word search against looking at every place."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from capital_access.llm import decontaminate as m


def brute(text, items, width):
    words, hit, found = m.words_of(text), set(), set()
    for item, other in items:
        for window in set(m.windows_of(m.words_of(other), width)):
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k:k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_search_equals_every_place():
    rng = random.Random(9)
    for _ in range(200):
        vocabulary = "a b c d".split()[:rng.randrange(2, 5)]
        items = [(str(k), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9)))) for k in range(6)]
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))
        width = rng.randrange(1, 6)
        n, stretches, found = m.hits_in(text, m.build_searches(items, width))
        assert (n, sum(b - a for a, b in stretches), sorted(found)) == brute(text, items, width)


def test_words():
    assert m.words_of("Ab-C9 É_é x İ") == [b"ab", b"c9", "É".encode(), "é x".encode(), "İ".encode()]


def test_blocks_nulls_and_repeated_items(spark, docs):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(2, " ".join(words[:15])), (10, " ".join(words[10:30])), (3, "Lone word"), (4, None), (5, " -- "), (None, "unnamed item text"),
                                   (2, " ".join(words[:15]))], "item_id long, text string")
    items = [(str(i) if i is not None else "", t) for i, t in bench.collect()]
    texts = {1: " ".join(words), 2: "x " * 500 + "lone WORD", 3: "", 4: None, 5: "an unnamed, item; text", 6: "nothing here", 7: " ".join(words[:12])}
    df = docs([*texts.items(), (6, "nothing here"), (None, "lone word")])
    for size in (1, 10_000):
        rows = m.scan_benchmark(df, bench, block_chars=size).collect()
        got = {r.doc_id: r for r in rows}
        for i, t in texts.items():
            assert (got[i].n_words, got[i].n_hit, got[i].items) == brute(t, items, 13)
            assert got[i].n_items == len(got[i].items)
            assert got[i].contaminated == (got[i].n_hit > 0 and 20 * got[i].n_hit >= got[i].n_words)
        assert got[1].items == ["10", "2"] and not got[2].contaminated and len(rows) == 9
        clash = df.withColumns({"hits": F.lit(1), "part": F.lit(2), "item_id": F.lit(3)})
        kept = m.drop_contaminated(clash, bench, block_chars=size)
        assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 6, 7]
    assert m.scan_benchmark(docs([]), bench).collect() == []
    none = {(r.n_hit, r.n_items, r.contaminated) for r in m.scan_benchmark(df, bench.where("false")).collect()}
    assert none == {(0, 0, False)} and sha256(b"").hexdigest() == df.select(F.sha2(F.lit(""), 256)).first()[0]


def test_blocks_are_searched_one_after_another(spark, docs):
    bench = spark.createDataFrame([(k, f"item number {k} of the list") for k in range(8)], "item_id long, text string")
    df = docs([(k, f"x item number {k} of the list") for k in range(8)] + [(8, None), (9, "x item number 3 of the list")])
    found = m.scan_benchmark(df, bench, block_chars=30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1  # only the words are counted in the last pass
    assert sorted((r.doc_id, r.items) for r in found.collect()) == [*((k, [str(k)]) for k in range(8)), (8, []), (9, ["3"])]
