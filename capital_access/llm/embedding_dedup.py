"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import bounded_sample
from capital_access.llm.components import connected_components
from capital_access.session import settle


@dataclass(frozen=True)
class CodeRule:
    """Codes of at most ``bits`` bits in ``tables`` substrings, searched within ``radius`` bits of each.

    A pair whose codes differ in at most ``tables * (radius + 1) - 1`` bits has a
    substring with at most ``radius`` errors, so the search finds all of these;
    of the others it finds most. Substrings should be about as long as the
    binary logarithm of the vectors in a label, so that a bucket holds a few.
    The rotation is learnt from at most ``sample`` vectors, chosen by a hash of their ids.
    A bucket of more than ``dense`` vectors is compared in blocks of about ``block`` by ``block``.

    ``tables`` and ``radius`` hold where they find the share ``recall`` of pairs at
    the least cosine, measured on the sample; otherwise see :func:`search_shape`.
    """

    bits: int = 64
    tables: int = 4
    radius: int = 1
    sample: int = 8192
    rounds: int = 50
    dense: int = 128
    block: int = 1024
    recall: float = 0.98


def learn_rotation(vectors: np.ndarray, bits: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, rotated so that signs lose least.

    Rounds alternate between the codes of the rotated data and the rotation that
    brings the data closest to these codes (a Procrustes problem). The mean, which
    balances the bits, is shrunk towards zero where there are few vectors: that of
    two alike would set them apart.
    """
    dims = vectors.shape[1]
    if not len(vectors):
        return np.zeros(dims), np.eye(dims)[:, :bits]
    mean = vectors.mean(axis=0) * (len(vectors) / (len(vectors) + 32 * dims))  # few vectors say little about the mean
    centred = vectors - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    projection = directions[:, ::-1][:, :bits]
    reduced = centred @ projection
    rotation = np.linalg.qr(np.random.default_rng(42).standard_normal((reduced.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(reduced @ rotation >= 0, 1.0, -1.0).T @ reduced)
        rotation = (u @ vt).T
    return mean, projection @ rotation


def near_pair_errors(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray, least_cosine: float) -> list[np.ndarray]:
    """Where codes of near pairs differ, as tables of pairs by bits: of made pairs, and of pairs found if there are a hundred.

    ``vectors`` have length one. A made pair is a vector and one at exactly the
    least cosine in a random direction. Centring widens the angles of vectors
    with a common direction, so these errors cannot be told from the cosine.
    """
    if not len(vectors):
        return []
    rng = np.random.default_rng(42)

    def errors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0)

    x = np.tile(vectors, (-(-4096 // len(vectors)), 1))
    across = rng.standard_normal(x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    lengths = np.linalg.norm(across, axis=1, keepdims=True)
    found = [errors(x, least_cosine * x + np.sqrt(max(1 - least_cosine ** 2, 0)) * across / np.where(lengths > 0, lengths, 1))]
    pairs = []
    for k in range(0, len(vectors), 512):
        i, j = np.nonzero(vectors[k:k + 512] @ vectors.T >= least_cosine)
        i, j = i[i + k < j] + k, j[i + k < j]
        some = rng.permutation(len(i))[:1024]
        pairs.append((i[some], j[some]))
    i, j = map(np.concatenate, zip(*pairs))
    return found + [errors(vectors[i], vectors[j])] if len(i) >= 100 else found


def substrings(bits: int, tables: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each table's part of a code."""
    width = -(-bits // tables)
    return [(t * width, min(width, bits - t * width)) for t in range(tables) if t * width < bits]


def search_shape(errors: list[np.ndarray], bits: int, largest: Callable[[], int], rule: CodeRule) -> tuple[list[tuple[int, int]], int]:
    """(substrings, radius) of the search, given where near pairs differ and the number of vectors of the ``largest`` label.

    Those of the rule, if they find the share ``rule.recall`` of each kind of
    pairs. Else, of the same, two or four times as many tables and all radii, the
    ones that do so with the fewest look-ups and candidates.
    """
    def recall(parts: list[tuple[int, int]], radius: int) -> float:
        least = (np.min([e[:, at:at + size].sum(axis=1) for at, size in parts], axis=0) for e in errors)
        return min((float((x <= radius).mean()) for x in least), default=1.0)

    parts = substrings(bits, rule.tables)
    if recall(parts, rule.radius) >= rule.recall:
        return parts, rule.radius
    n, shapes = largest(), []
    for tables in (rule.tables, 2 * rule.tables, 4 * rule.tables):
        parts = substrings(bits, tables)
        radius = next(r for r in range(parts[0][1] + 1) if recall(parts, r) >= rule.recall or r == parts[0][1])
        lookups = [sum(comb(size, r) for r in range(radius + 1)) for _, size in parts]
        shapes.append((sum(k * (1 + n / 2 ** size) for k, (_, size) in zip(lookups, parts)), tables, parts, radius))
    _, _, parts, radius = min(shapes)
    return parts, radius


def usable(vec: Column, label: Column, vec_id: Column) -> Column:
    """Has an id, a label and finite components, not all of them zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(vec: Column) -> Column:
    """The direction in double precision, scaled to a largest component of one, so that squares neither overflow nor vanish."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    return F.zip_with(wide, F.array_repeat(F.array_max(F.transform(wide, F.abs)), F.size(vec)), lambda x, largest: x / largest)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_links(vectors: DataFrame, least_cosine: float = 0.98, rule: CodeRule = CodeRule()) -> DataFrame:
    """Rows (node, other, linked): links of ``node``s whose ``unit`` vectors under one ``label`` are at least that similar.

    ``node`` is a struct that names a vector, ``copies`` its weight. The sum of
    ``linked`` over the rows of a node is the weight of all nodes linked with it
    directly; ``other`` is one that links lead to, and all rows together connect
    whatever is linked.

    Every vector enters each table under its substring and is looked up under
    all substrings within the radius. A pair found in several tables counts in
    the first of them, which both codes tell, so no later deduplication is
    needed. Candidates whose codes differ in far more bits than near pairs of the
    sample do are cut; all others are reranked.

    Small buckets meet in a sort-merge join of codes, and vectors are fetched for
    the candidates left: two rows a link. In larger ones, such as a group of near
    copies fills, pairs would be rows growing with the square: there the vectors
    themselves are dealt to blocks (see :func:`_dense_links`).
    """
    dims = vectors.agg(F.max(F.size("unit"))).first()[0] or 0
    if not dims:
        return vectors.select("node", F.col("node").alias("other"), F.lit(0).cast("long").alias("linked")).where("false")
    bits = min(rule.bits, dims)
    chosen = bounded_sample(vectors.select("node", "unit"), rule.sample, "node").toPandas()["unit"]

    def padded(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), dims))
        for k, v in enumerate(column):
            out[k, :len(v)] = v
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    fitted = padded(chosen)
    fitted = fitted[np.lexsort(fitted.T)]  # whatever order the rows came in
    mean, projection = learn_rotation(fitted, bits, rule.rounds)
    differing = near_pair_errors(fitted, mean, projection, least_cosine)
    parts, radius = search_shape(differing, bits, lambda: vectors.groupBy("label").count().agg(F.max("count")).first()[0], rule)
    most = most_errors(least_cosine, bits, differing)
    weights = np.left_shift(np.uint64(1), np.arange(bits, dtype="u8"))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            on = (padded(frame["unit"]) - mean) @ projection >= 0
            codes = (on * weights).sum(axis=1, dtype="u8").view("i8")
            yield pd.DataFrame({"vec_id": frame["vec_id"], "tag": frame["tag"], "label": frame["label"], "dims": frame["unit"].map(len), "code": codes})

    id_type, label_type = (vectors.select(c).schema[0].dataType.simpleString() for c in ("node.vec_id", "label"))
    codes = settle(
        vectors.select("node.vec_id", "node.tag", "label", "unit")
        .mapInPandas(coded, f"vec_id {id_type}, tag long, label {label_type}, dims int, code long")
        .select(F.struct("vec_id", "tag").alias("node"), "label", "dims", "code"), "codes")

    def part(code: Column, at: int, size: int) -> Column:
        return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))

    def entries(t: int, flips: list[int]) -> Column:
        return F.transform(F.split(F.lit(",".join(map(str, flips))), ",").cast("array<long>"),
                           lambda f: F.struct(F.lit(t).alias("t"), part(F.col("code"), *parts[t]).bitwiseXOR(f).alias("part")))

    def flips(size: int) -> list[int]:
        found = {0}
        for _ in range(radius):
            found |= {f ^ 1 << b for f in found for b in range(size)}
        return sorted(found)

    own = F.concat(*(entries(t, [0]) for t in range(len(parts))))
    near = F.concat(*(entries(t, flips(size)) for t, (_, size) in enumerate(parts)))
    bucket = ["label", "dims", "t", "part"]
    stored, asked = (codes.select("node", "code", "label", "dims", F.inline(found)) for found in (own, near))
    large = settle(stored.groupBy(bucket).agg(F.count("*").alias("n_stored")).where(F.col("n_stored") > rule.dense), "large")

    few = stored.join(large, bucket, "left_anti").withColumnsRenamed({"node": "a", "code": "code_a"})
    errors = F.col("code_a").bitwiseXOR(F.col("code_b"))
    first = F.lit(True)
    for t, (at, size) in enumerate(parts):
        first = first & ((F.col("t") <= t) | (F.bit_count(part(errors, at, size)) > radius))
    candidates = (
        few.join(asked.withColumnsRenamed({"node": "b", "code": "code_b"}), bucket)
        .where((F.col("a") < F.col("b")) & first & (F.bit_count(errors) <= most)).select("a", "b"))
    one, two = (vectors.select(F.col("node").alias(k), F.col("unit").alias(f"unit_{k}"), F.col("copies").alias(f"copies_{k}")) for k in "ab")
    links = candidates.join(one, "a").join(two, "b").where(cosine(F.col("unit_a"), F.col("unit_b")) >= least_cosine)
    sparse = links.select(F.inline(F.array(*(
        F.struct(F.col(x).alias("node"), F.col(y).alias("other"), F.col(f"copies_{y}").alias("linked")) for x, y in ("ab", "ba")))))
    if large.isEmpty():
        return sparse
    return sparse.unionByName(_dense_links(stored, asked, large, bucket, vectors, parts, radius, most, least_cosine, rule))


def linked_in_block(mine: pd.DataFrame, theirs: pd.DataFrame, earlier: list[tuple[int, int]], radius: int, most: int,
                    least_cosine: float) -> pd.DataFrame:
    """Links of the stored vectors of a block (``mine``) with the greater ones asked for, as rows (node, other, linked).

    Both have vec_id, tag, code, unit and copies. ``earlier`` are the substrings
    of the tables before this one, where a pair within the radius has counted.
    One row for each vector with links: their weight, and the least vector that
    links within the block lead to.
    """
    if mine.empty or theirs.empty:  # a block that the hash left empty
        return pd.DataFrame(columns=["vec_id", "tag", "other_id", "other_tag", "linked"])
    names = [list(zip(f["vec_id"], f["tag"])) for f in (mine, theirs)]
    nodes = sorted({*names[0], *names[1]})
    rank = {node: k for k, node in enumerate(nodes)}
    row, column = (np.array([rank[n] for n in found], "i8") for found in names)
    x, y = (np.array(f["unit"].tolist(), "f8") for f in (mine, theirs))
    errors = mine["code"].to_numpy("i8").view("u8")[:, None] ^ theirs["code"].to_numpy("i8").view("u8")
    met = (row[:, None] < column) & (np.bitwise_count(errors) <= most)
    for at, size in earlier:
        met &= np.bitwise_count(errors >> np.uint64(at) & np.uint64((1 << size) - 1)) > radius
    met &= x @ y.T / np.sqrt((x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1)) >= least_cosine

    linked, least = np.zeros(len(nodes), "i8"), np.arange(len(nodes))
    linked[row] += met @ theirs["copies"].to_numpy("i8")
    linked[column] += mine["copies"].to_numpy("i8") @ met
    while True:
        before = least.copy()
        least[row] = np.minimum(least[row], np.where(met, least[column], len(nodes)).min(axis=1, initial=len(nodes)))
        least[column] = np.minimum(least[column], np.where(met, least[row][:, None], len(nodes)).min(axis=0, initial=len(nodes)))
        least = least[least]
        if (least == before).all():
            break
    found = np.flatnonzero(linked)
    ends = [nodes[k] for k in found], [nodes[k] for k in least[found]]
    return pd.DataFrame({"vec_id": [n[0] for n in ends[0]], "tag": [n[1] for n in ends[0]], "other_id": [n[0] for n in ends[1]],
                         "other_tag": [n[1] for n in ends[1]], "linked": linked[found]})


def _dense_links(stored: DataFrame, asked: DataFrame, large: DataFrame, bucket: list[str], vectors: DataFrame,
                 parts: list[tuple[int, int]], radius: int, most: int, least_cosine: float, rule: CodeRule) -> DataFrame:
    """The links found in the ``large`` buckets.

    The two sides of a bucket are cut by hash into blocks of about ``rule.block``
    vectors, and each two blocks meet in a group of their own. It gives a row for
    each vector, not for each pair. So no task holds more than two blocks, however
    many vectors a bucket has, and every pair is compared.
    """
    asked = settle(asked.join(large, bucket), "asked")
    sizes = settle(asked.groupBy(bucket).agg(F.count("*").alias("n_asked")).join(large, bucket), "sizes")
    blocks = {side: F.ceil(F.col(f"n_{side}") / rule.block).cast("int") for side in ("stored", "asked")}

    def dealt(rows: DataFrame, side: str, other: str, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), blocks[side]).cast("int")
        against = F.explode(F.sequence(F.lit(0), blocks[other] - 1))
        return (
            rows.select("node", "code", *bucket).join(sizes, bucket).join(vectors.select("node", "unit", "copies"), "node")
            .select(*bucket, block.alias(mine), against.alias(theirs), F.lit(side == "stored").alias("is_stored"),
                    "node.vec_id", "node.tag", "code", "unit", "copies"))

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["is_stored"].to_numpy("bool")
        return linked_in_block(rows[mine], rows[~mine], parts[:int(rows["t"].iloc[0])], radius, most, least_cosine)

    met = dealt(stored, "stored", "asked", "i", "j").unionByName(dealt(asked, "asked", "stored", "j", "i"))
    id_type = met.schema["vec_id"].dataType.simpleString()
    return (
        met.groupBy(*bucket, "i", "j").applyInPandas(compared, f"vec_id {id_type}, tag long, other_id {id_type}, other_tag long, linked long")
        .select(F.struct("vec_id", "tag").alias("node"), F.struct(F.col("other_id").alias("vec_id"), F.col("other_tag").alias("tag")).alias("other"), "linked"))


def most_errors(least_cosine: float, bits: int, errors: Sequence[np.ndarray] = ()) -> int:
    """Bits in which codes of vectors at that cosine differ with a probability of less than about one in a million.

    A sign differs with probability angle / pi, or more where centring widens the
    angle: the ``errors`` of near pairs tell. The greatest of the means counts,
    with five standard deviations and two bits for codes that fit the data worse.
    """
    p = float(np.arccos(np.clip(least_cosine, -1, 1)) / np.pi)
    counts = [e.sum(axis=1) for e in errors]
    spread = [(bits * p, np.sqrt(bits * p * (1 - p))), *((c.mean(), c.std()) for c in counts)]
    return int(min(bits, max(np.ceil(mean + 5 * deviation + 2) for mean, deviation in spread)))


def vector_groups(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98,
    rule: CodeRule = CodeRule(),
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Rows of equal labels and lengths are linked if their cosine, in double
    precision, is at least ``least_cosine``. ``n_links`` counts the rows linked
    directly, ``component_id`` is the least id that links lead to, the own one
    included, and ``kept`` tells the rows that have that id.

    Rows without an id or label, and vectors that are missing, empty, all zero
    or hold missing or non-finite components, link with nothing. Equal vectors
    are one vector in the search: copies are counted, never paired. A repeated
    row is repeated, and each counts as a link of the other; rows of one id with
    different vectors are different vectors. Other columns are not read.
    """
    rows = table.select(as_col(id_col).alias("vec_id"), as_col(vec_col).alias("vec"), as_col(label_col).alias("label"))
    fit = usable(F.col("vec"), F.col("label"), F.col("vec_id"))
    good = rows.where(fit).select("vec_id", "label", _unit(F.col("vec")).alias("unit"))
    classes = settle(
        good.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
        .select(F.struct("vec_id", F.xxhash64("label", "unit").alias("tag")).alias("node"), "label", "unit", "copies"), "classes")
    members = good.join(classes, ["label", "unit"]).select("vec_id", "node", "copies")
    links = settle(vector_links(classes.select("node", "label", "unit", "copies"), least_cosine, rule), "links")
    counted = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = connected_components(links.where("node != other"), "node", "other")
    found = settle(counted.join(roots, "node"), "found")
    linked = members.join(found, "node", "left").select(
        "vec_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("root.vec_id", "node.vec_id").alias("component_id"))
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
