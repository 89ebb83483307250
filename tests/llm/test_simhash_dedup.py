"""Golay keys, fingerprints and groups against comparing everything with everything."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from capital_access.llm import simhash_dedup as m
from capital_access.llm.components import connected_components

TABLES = m.golay_tables()


def test_golay_indices_share_within_two_errors():
    words = np.array([0, 1, 0x7FFFFF, 0x2A5A5A, 0x123456], "i8")
    indices, counts = m.golay_indices(words, TABLES)
    assert set(counts.sum(axis=1)) <= {1, 6}
    for word in words.tolist():
        own = keys_of(word)
        for bits in [b for n in (1, 2) for b in combinations(range(23), n)]:
            assert own & keys_of(word ^ sum(1 << b for b in bits))


def keys_of(word):
    indices, counts = m.golay_indices(np.array([word], "i8"), TABLES)
    return set(indices[0][counts[0]].tolist())


def test_search_keys_of_close_fingerprints_meet():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        place, key = m.search_keys(np.array([a, b], "u8"))
        assert set(key[place == 0]) & set(key[place == 1])


def plain_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(spark):
    for text in (None, "", " \t", "One", "one two", "A b c d", "É é x y z", "a b c " * 50, "w\x0bx\x0cy\rz"):
        assert m.fingerprint(text) == plain_fingerprint(text)
    same = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert m.fingerprint("a b c") == same & (1 << 64) - 1


def groups(values, most):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if bin(a ^ b).count("1") <= most:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_in_small_and_large_buckets(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(25)}
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for most in (1, 2):
        expected = groups(values, most)
        for bucket in (2, 1000):
            links = m.fingerprint_links(df, most, small_bucket=bucket)
            assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= most for r in links.collect())
            got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
            for a, b in combinations(values, 2):
                x, y = signed(a), signed(b)
                assert (got.get(x, x) == got.get(y, y)) == (expected[a] == expected[b])
    assert m.fingerprint_links(df, 0).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 200), (300, 200), (None, 5), (5, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 300: 200}
    assert connected_components(df.where("false"), "a", "b").collect() == []


def test_groups_equal_brute_force(small):
    df = small("documents")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in df.select("doc_id", "text").collect()}
    root = groups(set(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in m.simhash_groups(df).collect()}
    assert got == {i: (p, least[root[p]]) for i, p in prints.items()}
    kept = m.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_nulls_copies_and_clashing_names(spark, docs):
    text = "one two three four five six seven"
    df = docs([(3, text), (2, text.upper()), (None, text), (None, None), (8, ""), (9, None), (9, None), (None, "lonely words without any id")])
    got = sorted(((r.doc_id, r.component_id) for r in m.simhash_groups(df).collect()), key=str)
    assert got == [(2, 2), (3, 2), (8, 8), (9, 8), (9, 8), (None, 2), (None, 8), (None, None)]
    clash = df.withColumns({"row_mark": F.lit(1), "key": F.lit(2), "fp": F.lit(3), "group": F.lit(4), "id_mark": F.lit(5), "row_wanted": F.lit(6)})
    kept = m.drop_near_copies(clash)
    assert kept.columns == clash.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(2, text.upper()), (8, ""), (None, "lonely words without any id")]
    twice = docs([(1, text), (1, text), (1, "quite another text that shares the id of others")])
    assert sorted(r.text for r in m.drop_near_copies(twice).collect()) == ["one two three four five six seven", "quite another text that shares the id of others"]
    assert m.simhash_groups(docs([])).collect() == [] and m.drop_near_copies(docs([])).collect() == []
