"""Links and components of vectors against all pairs."""

import numpy as np
import pandas as pd
import pytest

from capital_access.llm import embedding_dedup as m

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """{row number: (links, component)}."""
    def fit(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and fit(v)]
    links, root = {k: set() for k in good}, {k: k for k in good}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, a in enumerate(good):
        for b in good[p + 1:]:
            x, y = (np.array(rows[k][1], "f4").astype("f8") for k in (a, b))
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
                links[b].add(a)
                root[find(a)] = find(b)
    parts = {}
    for k in good:
        parts.setdefault(find(k), []).append(rows[k][0])
    return {k: (len(links[k]), min(parts[find(k)])) if k in root else (0, rows[k][0]) for k in range(len(rows))}


def near(rng, centre, cosine):
    """A vector at exactly that cosine."""
    other = rng.standard_normal(len(centre))
    other -= other @ centre * centre
    return cosine * centre + np.sqrt(1 - cosine ** 2) * other / np.linalg.norm(other)


def test_recall_against_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(40):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for _ in range(6):
            rows.append((len(rows), near(rng, centre, rng.uniform(0.975, 0.999)).tolist(), k % 3))
    rows += [(len(rows) + k, rng.standard_normal(64).tolist(), k % 3) for k in range(300)]
    expected = brute(rows)
    got = {r.vec_id: r for r in m.vector_groups(spark.createDataFrame(rows, SHAPE)).collect()}
    wanted = sum(n for n, _ in expected.values())
    found = sum(r.n_links for r in got.values())
    assert wanted > 200 and 0.97 * wanted <= found <= wanted
    assert all(got[k].n_links <= n for k, (n, _) in expected.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_of_large_buckets_give_the_same(spark):
    """A group of near copies, a chain of links and copies, all compared in blocks of a few vectors."""
    rng, rows = np.random.default_rng(5), []
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    rows += [(k, near(rng, centre, rng.uniform(0.985, 0.9999)).tolist(), 1) for k in range(90)]
    turn = np.deg2rad(8)  # each links with its neighbours only
    rows += [(500 - k, (np.cos(k * turn) * np.eye(1, 64)[0] + np.sin(k * turn) * np.eye(1, 64, 1)[0]).tolist(), 1) for k in range(12)]
    rows += [(600 + k, rows[k % 3][1], 1) for k in range(9)]
    rows += [(700 + k, rng.standard_normal(64).tolist(), k % 2) for k in range(40)]
    df, expected = spark.createDataFrame(rows, SHAPE), brute(rows)
    results = [sorted(m.vector_groups(df, rule=m.CodeRule(radius=3, dense=dense, block=block)).collect())
               for dense, block in ((10_000, 1024), (1, 16))]
    assert results[0] == results[1]
    got = {r.vec_id: r for r in results[0]}
    wanted = sum(n for n, _ in expected.values())
    assert wanted > 2000 and 0.95 * wanted <= sum(r.n_links for r in got.values()) <= wanted
    assert {got[i].component_id for i in (600, 608, 0, 2)} == {0}


def test_a_block_names_vectors_by_text_or_number():
    same = {"code": [0, 0, 0], "unit": [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]], "copies": [2, 3, 5]}
    for names in ([1, 2, 3], ["a", "b", "c"]):
        block = pd.DataFrame({"vec_id": names, "tag": [7, 7, 7], **same})
        found = m.linked_in_block(block, block, [], 1, 16, 0.98)
        assert found.values.tolist() == [[names[0], 7, names[0], 7, 3], [names[1], 7, names[0], 7, 2]]
        assert m.linked_in_block(block, block, [(0, 1)], 1, 16, 0.98).empty  # counted in an earlier table
        assert m.linked_in_block(block, block.iloc[:0], [], 1, 16, 0.98).empty


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (8, [1.0, 0.0], None), (7, None, 1), (6, [0.0, 0.0], 1),
            (5, [nan, 1.0], 1), (4, [inf, 1.0], 1), (1, [], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0], 1), (12, [1.0, 0.01], 1),
            (3, [0.0, 1.0], 1)]
    expected = sorted(((rows[k][0], *v) for k, v in brute(rows).items()), key=str)
    got = m.vector_groups(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected
    assert {r.kept for r in got if r.vec_id is None} == {False}


def test_empty_table_and_clashing_columns(spark):
    assert m.vector_groups(spark.createDataFrame([], SHAPE)).collect() == []
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 4), (2, [1.0, 0.0], 1, 4)], SHAPE + ", unit int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in m.vector_groups(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_rotation_keeps_angles_and_balances_bits():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 16)) * np.arange(1, 17)
    mean, projection = m.learn_rotation(x, 16)
    assert np.allclose(projection.T @ projection, np.eye(16))
    assert ((((x - mean) @ projection >= 0).mean(axis=0) - 0.5) ** 2).max() < 0.02
    assert m.most_errors(1.0, 64) == 2 and m.most_errors(0.98, 64) >= 12


@pytest.mark.parametrize("cosine", [0.9799, 0.9801])
def test_threshold_is_exact(spark, cosine):
    a = np.eye(1, 64)[0]
    b = cosine * a + np.sqrt(1 - cosine ** 2) * np.eye(1, 64, 1)[0]
    found = m.vector_groups(spark.createDataFrame([(1, a.tolist(), 0), (2, b.tolist(), 0)], SHAPE)).collect()
    assert {r.n_links for r in found} == {int(cosine >= 0.98)}


def test_recall_on_vectors_with_a_common_direction(spark):
    """Mean cosine 0.95: centring widens the angle of a link, so codes of links differ in far more bits."""
    rng, rows, common = np.random.default_rng(17), [], np.eye(1, 64)[0]
    for k in range(3000):
        other = np.append(0, rng.standard_normal(63))
        centre = np.sqrt(0.95) * common + np.sqrt(0.05) * other / np.linalg.norm(other)
        rows += [(2 * k, centre.tolist(), k % 10), (2 * k + 1, near(rng, centre, rng.uniform(0.98, 0.99)).tolist(), k % 10)]
    x, labels = np.array([r[1] for r in rows], "f4").astype("f8"), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98) & (labels[:, None] == labels)
    expected = links.sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in m.vector_groups(spark.createDataFrame(rows, SHAPE)).collect()}
    assert expected.sum() > 5000 and 0.97 * expected.sum() <= sum(found.values()) <= expected.sum()
    assert all(found[i] <= n for i, n in enumerate(expected))
