"""Conversations as a trie of the beginnings they share, with subtree totals by parallel tree contraction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from capital_access.functions.nulls import as_col
from capital_access.session import scratch_path, settle, settle_at

#: Turns of a conversation that are summed up together.
_SEGMENT = 1024
#: Span of conversation ids whose list is one value.
_SPAN = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv_id, place, role, text: places count from 0 by turn (missing first), then role and text.

    Missing roles and texts are empty; rows without a conversation id are left
    out. All rows are sorted together and a conversation is numbered from the
    counts of the partitions it lies in, so that one of any length is never
    gathered in a task.
    """
    order = ["conv_id", "turn", "role", "text"]
    read = turns.where(as_col(conv_col).isNotNull()).select(
        as_col(conv_col).cast("long").alias("conv_id"), as_col(turn_col).alias("turn"),
        F.coalesce(as_col(role_col), F.lit("")).alias("role"), F.coalesce(as_col(text_col), F.lit("")).alias("text"))
    in_order = settle(
        read.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn").withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row", 33)), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_order.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n")).select(
        "conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return in_order.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first") + F.col("ahead")).alias("place"), "role", "text")


def share_beginnings(numbered: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The numbered turns, each conversation's first h replaced by those of the first of its ``group``.

    h is the CRC-32 of the decimal id modulo ``most``. A conversation takes as
    many of the h turns as the first of its group has, none if that is absent;
    its own turns follow from place h on, numbered without a gap. At most
    ``most - 1`` turns of a conversation meet at most ``2 * group`` ids.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    origin = (F.col("conv_id") - F.col("conv_id") % group).alias("origin")
    firsts = (
        numbered.where((F.col("place") < most - 1) & (F.col("conv_id") % group == 0))
        .groupBy(F.col("conv_id").alias("origin")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("firsts")))
    taken = F.slice(F.coalesce("firsts", F.array().cast(firsts.schema["firsts"].dataType)), F.lit(1), F.col("h").cast("int"))
    heads = settle(
        numbered.where("place = 0").select("conv_id", origin, h.alias("h")).join(firsts, "origin", "left")
        .select("conv_id", "h", taken.alias("taken")), "heads")
    own = numbered.join(heads.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "role", "text")
    return heads.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.place", "t.role", "t.text").unionByName(own)


def _digest_parts(value: Column) -> list[Column]:
    """Four 32-bit numbers of a digest; sums of less than 2 ** 31 of them fit a long."""
    digest = F.sha2(value, 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def beginnings(numbered: DataFrame) -> DataFrame:
    """Rows conv_id, depth, node, parent, words, is_last for each first ``depth`` turns of each conversation.

    ``node`` is a key of the sequence: the sums of 128-bit digests of its turns,
    each taken with its place, so that keys of beginnings are running sums. These
    are formed in segments of 1,024 turns and carried over from sums of segments.
    """
    parts = ["k0", "k1", "k2", "k3"]
    turn = F.concat(F.col("place").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    hashed = settle(
        numbered.withColumn("digest", F.array(*_digest_parts(turn)))
        .select("conv_id", "place", *(F.col("digest")[k].alias(p) for k, p in enumerate(parts)),
                F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"), F.floor(F.col("place") / _SEGMENT).alias("segment")), "digests")
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    segments = hashed.groupBy("conv_id", "segment").agg(*(F.sum(p).alias(p) for p in parts)).select(
        "conv_id", "segment", *(F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"ahead_{p}") for p in parts),
        (F.count("*").over(after) == 0).alias("last_segment"))
    so_far = Window.partitionBy("conv_id", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id", "segment")
    sums = hashed.join(segments, ["conv_id", "segment"]).select(
        "conv_id", (F.col("place") + 1).alias("depth"), "words", *parts, *((F.sum(p).over(so_far) + F.col(f"ahead_{p}")).alias(f"sum_{p}") for p in parts),
        (F.col("last_segment") & (F.max("place").over(whole) == F.col("place"))).alias("is_last"))

    def key(depth: Column, values: Sequence[Column]) -> Column:
        return F.when(depth == 0, "0").otherwise(F.concat_ws(":", depth.cast("string"), *(v.cast("string") for v in values)))

    return sums.select(
        "conv_id", "depth", key(F.col("depth"), [F.col(f"sum_{p}") for p in parts]).alias("node"),
        key(F.col("depth") - 1, [F.col(f"sum_{p}") - F.col(p) for p in parts]).alias("parent"), "words", "is_last")


def _tell(rows: DataFrame, key: str, messages: Sequence[dict[str, Column]], sums: Sequence[str] = ()) -> DataFrame:
    """The messages of all rows by their ``key``: columns in ``sums`` added up, of others the greatest; a message without a key goes to nobody.

    Columns a message lacks are missing in it, and must not be missing in all.
    The first message is a row's own; keys that only others wrote to are left out.
    """
    kinds = {name: field.dataType for message in messages for name, field in zip(message, rows.select(*message.values()).schema)}
    sent = rows.select(F.inline(F.array(*(
        F.struct(*(message.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()), F.lit(k == 0).alias("here"))
        for k, message in enumerate(messages)))))
    return sent.where(F.col(key).isNotNull()).groupBy(key).agg(
        *((F.sum if name in sums else F.max)(name).alias(name) for name in kinds if name != key), F.max("here").alias("here")).where("here").drop("here")


def subtree_totals(nodes: DataFrame, values: Sequence[str], node_col: str = "node", parent_col: str = "parent") -> DataFrame:
    """Rows (node, *values): the sums of the values over each node's subtree, its top included.

    Parallel tree contraction. A round rakes all leaves, whose totals are then
    known, into their parents, and compresses chains: of the inner nodes with one
    child left, those whose hash is less than that of their parent and of the
    child go, and the child hangs below their parent, with what they held on its
    edge. So a chain loses a third of its nodes a round, a bush all its leaves,
    and the rounds grow with the logarithm of the nodes. Then the compressed
    nodes come back, last round first: the total of one is what it held, and its
    child's total.

    A node without a parent is a root; several are several trees. Ids must not
    repeat. In a round, nodes write to their parents, then to their children,
    and what is written to a node is reduced before its shuffle, so a node with
    a third of all others below it burdens no task. The joins of the way back
    are on keys that are unique on both sides. Every round is one table in the
    shared folder, and those of all rounds are read as one, so that plans do not
    grow with the rounds.
    """
    held, edges, kid_edges = [f"held_{v}" for v in values], [f"edge_{v}" for v in values], [f"kid_edge_{v}" for v in values]
    gains = [f"gain_{v}" for v in values]
    zero = F.lit(0).cast("long")

    def own(*names: str) -> dict[str, Column]:
        return {name: F.col(name) for name in names}

    def added(totals: Sequence[str], more: Sequence[str]) -> list[Column]:
        return [(F.col(t) + F.coalesce(m, zero)).alias(t) for t, m in zip(totals, more)]

    def pairs(*names: Sequence[str]) -> list[tuple[Column, ...]]:
        return [tuple(F.col(n) for n in pair) for pair in zip(*names)]

    def rank(node: str) -> Column:
        return F.struct(F.xxhash64(node, F.lit(turn)), node)

    state = nodes.select(
        as_col(node_col).alias("node"), as_col(parent_col).alias("parent"), *(as_col(v).cast("long").alias(h) for v, h in zip(values, held)),
        *(zero.alias(e) for e in edges), F.lit(None).cast("long").alias("kids"))
    turn, shared = 0, scratch_path(nodes.sparkSession, "contraction")
    rounds, expanded = [], []
    while True:
        leaf = F.coalesce(F.col("kids") == 0, F.lit(False))
        raked = _tell(state, "node", [
            {"node": F.when(~leaf, F.col("node"))} | own("parent", *held, *edges),
            {"node": F.col("parent"), "kids": F.when(leaf, zero).otherwise(1), "child": F.when(~leaf, F.col("node"))}
            | {k: F.when(~leaf, F.col(e)) for k, e in zip(kid_edges, edges)} | {g: F.when(leaf, h + e) for g, (h, e) in zip(gains, pairs(held, edges))},
        ], sums=["kids", *gains]).select("node", "parent", *added(held, gains), *edges, F.coalesce("kids", zero).alias("kids"), "child", *kid_edges)
        gone = (F.col("kids") == 1) & F.col("parent").isNotNull() & (rank("node") < rank("child")) & (rank("node") < rank("parent"))
        hung = _tell(raked.withColumn("gone", F.coalesce(gone, F.lit(False))), "node", [
            own("node", "parent", *edges, "kids", "gone") | {"child": F.when(F.col("gone"), F.col("child"))}
            | {h: F.col(h) + F.when(F.col("gone"), F.col(k)).otherwise(zero) for h, k in zip(held, kid_edges)},
            {"node": F.when(F.col("gone"), F.col("child")), "up": F.col("parent")} | {g: h + e for g, (h, e) in zip(gains, pairs(held, edges))}])
        done = settle_at(hung.select("node", F.coalesce("up", "parent").alias("parent"), *held, *added(edges, gains), "kids", "child", "gone"), f"{shared}/round-{turn}")
        rounds.append(done)
        state, turn = done.where("NOT gone"), turn + 1
        if state.where("kids > 0").isEmpty():
            break

    def known(first: int) -> DataFrame:
        """Totals of the leaves from a round on, and of the nodes that came back."""
        done = together([f"{shared}/round-{k}" for k in range(first, turn)], rounds[0])
        left = done.where("NOT gone AND kids = 0").select("node", *(F.col(h).alias(v) for v, h in zip(values, held)))
        return left.unionByName(together([f"{shared}/expanded-{k}" for k in expanded], left)) if expanded else left

    def together(paths: Sequence[str], like: DataFrame) -> DataFrame:
        return nodes.sparkSession.read.schema(like.schema).parquet(*paths)

    for k in reversed(range(turn)):
        gone = rounds[k].where("gone").select("node", "child", *held)
        if not gone.isEmpty():
            below = known(k).withColumnRenamed("node", "child")
            settle_at(gone.join(below, "child").select("node", *((F.col(h) + F.col(v)).alias(v) for v, h in zip(values, held))), f"{shared}/expanded-{k}")
            expanded.append(k)
    return known(0)


def id_digests(members: DataFrame) -> DataFrame:
    """Rows node, digest: SHA-256 of a node's decimal ids in ascending order, joined by commas.

    Ids of a span of 4,096 are joined first; what then meets in one task is a row
    for each span, read as a stream, as a digest can only be taken in order.
    """
    spans = members.groupBy("node", F.floor(F.col("conv_id") / _SPAN).alias("span")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, sha256()
        for frame in frames:
            done = []
            for key, ids in zip(frame["node"], frame["ids"]):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["node", "digest"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "digest"])

    return spans.repartition("node").sortWithinPartitions("node", "span").mapInPandas(digests, "node string, digest string")


def prefix_trie(numbered: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``numbered`` has the turns (conv_id, place from 0 without gaps, role, text),
    ``conversations`` every conv_id once, also those without turns. A node is a
    distinct sequence of first turns, the root the empty one; its members are
    the conversations that begin with it, and ``conv_id`` is the least of them.
    ``saved_tokens`` sums over the subtree the words of a node's last text, once
    for each member but one. ``ends_sha256`` digests the members that end there.
    Without conversations there is no node. Missing roles and texts must have
    been replaced, as :func:`number_turns` does.

    What lies below a node with one member is a chain to one leaf that saves
    nothing, so it is raked into the node it hangs from before the first round of
    :func:`subtree_totals`, however long it is.

    A beginning that a third of all conversations share is counted before its
    shuffle. Only keys and counts travel after the digests of turns are taken.
    """
    begun = settle(beginnings(numbered), "beginnings")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit("0").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    inner = begun.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("words").alias("words"))
    plain = root.unionByName(inner)
    children = inner.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    counted = settle(plain.join(children, "node", "left").select(
        *plain.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_single")), F.monotonically_increasing_id().alias("id")), "nodes")
    parents = counted.select(F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    nodes = settle(counted.join(parents, "parent", "left").drop("parent"), "linked")
    totals = subtree_totals(
        nodes.where("n_convs > 1").select(
            "id", "parent_id", (F.col("n_single") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], "id", "parent_id")
    single = F.col("n_convs") == 1
    turnless = conversations.join(begun.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit("0").alias("node"), "conv_id")
    ends = id_digests(begun.where("is_last").select("node", "conv_id").unionByName(turnless))
    return (
        nodes.join(totals.withColumnRenamed("node", "id"), "id", "left").join(ends, "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                F.when(single, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), F.when(single, 0).otherwise(F.col("saved_tokens")).alias("saved_tokens"),
                F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      group: int = 20, most: int = 4) -> DataFrame:
    """:func:`prefix_trie` of the conversations rebuilt by :func:`share_beginnings`.

    Turns sort by ``turn_col`` (missing first), repeated ones by role and text;
    repeated rows are turns of their own. Missing roles and texts are empty;
    rows without a conversation id are left out; an empty table has no node. A
    text of any length becomes a digest before it is compared. Other columns are
    not read.
    """
    numbered = settle(number_turns(turns, conv_col, turn_col, role_col, text_col), "numbered")
    rebuilt = share_beginnings(numbered, group, most)
    return prefix_trie(rebuilt, numbered.where("place = 0").select("conv_id"))
