"""The trie against one built in memory; subtree totals against a walk."""

import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from capital_access.llm import prefix_trie as m

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, group=20, most=4):
    given = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            given.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [t[2:] for t in sorted(turns)] for c, turns in given.items()}
    out = {}
    for c, turns in given.items():
        h = crc32(str(c).encode()) % most
        origin = c - int(c - group * int(c / group))
        out[c] = given.get(origin, [])[:h] + turns[h:]
    return out


def brute(rows, group=20, most=4):
    convs = rebuilt(rows, group, most)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [k for k in members if k[:len(node)] == node]
        children = [k for k in below if len(k) == len(node) + 1]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaves = sum(not any(len(o) == len(k) + 1 and o[:-1] == k for o in members) for k in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), leaves, saved,
                    sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_a_trie_in_memory(turns):
    rng = random.Random(5)
    rows = []
    for conv in [*range(0, 25), 40, 41, 63, -3, -21, 1000, 5000, 9000, 9001]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["u", "a", None]), rng.choice(["x y", "x\tz", "", None, "é b c"])))
    rows += [(7, 0, "u", "same")] * 3 + [(None, 0, "u", "no conversation"), (8, 2, None, None)]
    clash = turns(rows).withColumns({c: F.lit(1) for c in ("node", "parent", "place", "row", "part", "words", "h")})
    assert found(m.conversation_trie(clash)) == brute(rows)


def test_few_and_none(turns):
    assert m.conversation_trie(turns([])).collect() == []
    assert m.conversation_trie(turns([(None, 1, "u", "x")])).collect() == []
    one = [(21, 0, "u", "a b")]  # its beginning is that of conversation 20, which is absent
    assert found(m.conversation_trie(turns(one))) == brute(one)


def test_long_conversations_and_long_texts(turns, monkeypatch):
    monkeypatch.setattr(m, "_SEGMENT", 16)
    rows = [(20 * c, t, "u", f"turn {t}" if t < 30 else f"{c} {t}") for c in (1, 2) for t in range(50)]
    rows += [(60, 0, "u", "word " * 400_000), (80, 0, "u", "word " * 400_000), (80, 1, "a", "end")]
    got = {r[:2]: r for r in found(m.conversation_trie(turns(rows)))}
    assert len(got) == 1 + 30 + 2 * 20 + 2
    assert got[20, 30][3:6] == (2, 2, 2) and got[20, 50][3:6] == (1, 0, 1) and got[40, 50][2] == 40
    assert got[20, 1][6] == 30 * 2 and got[60, 1][3:7] == (2, 1, 1, 400_000)
    assert got[20, 0][3:7] == (4, 2, 3, 400_060)


@pytest.mark.parametrize("shape", ["random", "chain", "broom", "trees"])
def test_subtree_totals(spark, shape):
    rng, n = random.Random(1), 40
    parent = {
        "random": [None] + [rng.randrange(max(0, k - 4), k) for k in range(1, n)], "chain": [None, *range(n - 1)],
        "broom": [None, *range(n // 2), *[n // 2] * (n // 2 - 1)], "trees": [None] * 3 + [rng.randrange(k - 3, k) for k in range(3, n)]}[shape]
    total = [1] * len(parent)
    other = [k * k for k in range(len(parent))]
    for k in range(len(parent) - 1, 0, -1):
        if parent[k] is not None:
            total[parent[k]] += total[k]
            other[parent[k]] += other[k]
    rows = [(f"n{k}", None if p is None else f"n{p}", 1, k * k) for k, p in enumerate(parent)]
    df = spark.createDataFrame(rows, "node string, parent string, a long, b long")
    assert {r["node"]: (r["a"], r["b"]) for r in m.subtree_totals(df, ["a", "b"]).collect()} == {
        f"n{k}": (t, o) for k, (t, o) in enumerate(zip(total, other))}


def test_digests_across_spans(spark):
    ids = [*range(-5000, 9000, 7)]
    df = spark.createDataFrame([("x", c) for c in ids] + [("y", 3)], "node string, conv_id long")
    got = {r["node"]: r["digest"] for r in m.id_digests(df).collect()}
    assert got == {"x": sha256(",".join(map(str, ids)).encode()).hexdigest(), "y": sha256(b"3").hexdigest()}


def test_plans_do_not_grow_with_the_rounds(spark, capsys):
    n = 60
    chain = spark.createDataFrame([(k, k - 1 if k else None, 1) for k in range(n)], "node long, parent long, a long")
    totals = m.subtree_totals(chain, ["a"])
    capsys.readouterr()
    totals.explain()
    assert capsys.readouterr().out.count("FileScan parquet") <= 2
    assert {r["node"]: r["a"] for r in totals.collect()} == {k: n - k for k in range(n)}


def test_tails_of_one_conversation_are_raked_at_once(turns, monkeypatch):
    contracted = []

    def totals(nodes, *args, f=m.subtree_totals):
        contracted.append(nodes.count())
        return f(nodes, *args)

    monkeypatch.setattr(m, "subtree_totals", totals)
    rows = [(20 * c, t, "u", f"turn {t}" if t < 2 else f"{c} {t}") for c in (1, 2, 3) for t in range(6)]
    rows += [(80, t, "u", f"turn {t}" if t < 2 else f"1 {t}") for t in range(6)] + [(100, 0, "a", "alone")]
    assert found(m.conversation_trie(turns(rows))) == brute(rows)
    assert contracted == [1 + 2 + 4]  # the root, two shared turns, four of two conversations alike


def test_a_conversation_and_its_only_turn(turns):
    for rows in ([(20, 0, None, None)], [(20, 0, "u", "a b"), (40, 0, "u", "a b")]):
        assert found(m.conversation_trie(turns(rows))) == brute(rows)
