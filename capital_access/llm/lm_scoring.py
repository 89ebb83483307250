"""Log-probabilities of documents under a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import ascii_lower, small_batches
from capital_access.llm.quality_ranker import held_out
from capital_access.session import settle

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The token behind the last word; no word is empty.
END = b""
#: A token's count is raised by this much, so that unseen ones have a share.
ADDED = 0.1


@dataclass(frozen=True)
class ModelShape:
    """Size of the model and of its training.

    The ``head`` most frequent tokens have a vector of their own; all others
    share ``buckets`` vectors, by a checksum. Together they are the cells of
    the model. ``width`` is the length of a vector, ``context`` the number of
    cells before a token that predict it, ``noise`` the samples a batch is told
    apart from. Training takes ``rounds`` steps over a share of the corpus each,
    all documents in all. Counts of the most frequent tokens, at most
    ``looked_up`` of at most ``longest`` bytes each, go to every task
    (``looked_up * (longest + 8)`` bytes); the others are joined.
    """

    head: int = 320
    buckets: int = 64
    width: int = 24
    context: int = 2
    noise: int = 64
    rounds: int = 3
    batch: int = 1024
    rate: float = 0.05
    looked_up: int = 65_536
    longest: int = 64
    seed: int = 11


def token_pieces(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The tokens of a text, the end last, in lists from about ``most`` bytes each."""
    data, start = ascii_lower(text), 0
    while len(data) - start > most:
        space = _SPACE.search(data, start + most)
        if space is None:
            break
        yield data[start:space.start()].split()
        start = space.start()
    yield [*data[start:].split(), END]


def token_counts(docs: DataFrame, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """Rows token, times over all texts. A task adds up to ``most`` different tokens before it hands them on."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()

        def handed() -> pd.DataFrame:
            return pd.DataFrame({"token": list(found), "times": np.fromiter(found.values(), "i8", len(found))})

        for frame in frames:
            for text in frame["text"]:
                for words in token_pieces(text):
                    found.update(words)
                    if len(found) >= most:
                        yield handed()
                        found.clear()
        if found:
            yield handed()

    return docs.select(as_col(text_col).alias("text")).mapInPandas(counted, "token binary, times long").groupBy("token").agg(F.sum("times").alias("times"))


class Vocabulary:
    """Counts of frequent tokens, and the cells of all.

    ``tokens`` and ``times`` list the tokens looked up, most frequent first;
    ``weights`` and ``kinds`` give the occurrences and the different tokens of
    each bucket, those looked up included, the head not.
    """

    def __init__(self, shape: ModelShape, tokens: list[bytes], times: np.ndarray, total: int, distinct: int, weights: np.ndarray, kinds: np.ndarray):
        self.shape, self.tokens, self.times, self.total, self.distinct, self.weights, self.kinds = shape, tokens, times, total, distinct, weights, kinds
        self.head = min(shape.head, len(tokens))
        self.cells = self.head + shape.buckets

    @property
    def unigrams(self) -> np.ndarray:
        """Share of each cell in the corpus, raised so that none is zero."""
        found = np.concatenate([self.times[:self.head], self.weights]) + 1.0
        return found / found.sum()


class Lookup(dict):
    """Number of a token: its place among those looked up, or behind them its bucket."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((t, k) for k, t in enumerate(vocabulary.tokens))
        self.known, self.buckets = len(self), vocabulary.shape.buckets

    def __missing__(self, token: bytes) -> int:
        return self.known + crc32(token) % self.buckets


class Reader:
    """What the numbers of :class:`Lookup` stand for: cells, and the shares of tokens in the corpus and in their cells."""

    def __init__(self, v: Vocabulary):
        self.lookup, self.head, self.known = Lookup(v), v.head, len(v.tokens)
        buckets = np.array([crc32(t) % v.shape.buckets for t in v.tokens[v.head:]], "i8")
        tail = np.arange(v.shape.buckets)
        self.cell = np.concatenate([np.arange(v.head), v.head + buckets, v.head + tail]).astype("i4")
        all_base, all_cell = np.log10(v.total + ADDED * (v.distinct + 1)), np.log10(v.weights + ADDED * (v.kinds + 1))
        logs = np.log10(v.times + ADDED)
        # A token that is not looked up lacks the logarithm of its own count here.
        self.base = np.concatenate([logs - all_base, np.full(len(tail), -all_base)])
        self.within = np.concatenate([np.zeros(v.head), logs[v.head:] - all_cell[buckets], -all_cell])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.lookup.__getitem__, words), "i4", len(words))


def build_vocabulary(counts: DataFrame, shape: ModelShape) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of all tokens, and the counts of those that are not looked up.

    Which are looked up is decided by count alone, in steps of a sixteenth power
    of two: a histogram of the steps tells where at most ``looked_up`` remain, so
    nothing is sorted and no more than these come to the driver.
    """
    step = F.when(F.octet_length("token") <= shape.longest, F.floor(F.log2("times") * 16)).otherwise(-1)
    bucket = (F.crc32("token") % shape.buckets).cast("int")
    sizes = counts.groupBy(bucket.alias("bucket")).agg(F.sum("times").alias("weight"), F.count("*").alias("kinds")).collect()
    weights, kinds = np.zeros(shape.buckets, "i8"), np.zeros(shape.buckets, "i8")
    for row in sizes:
        weights[row["bucket"]], kinds[row["bucket"]] = row["weight"], row["kinds"]
    total, distinct = int(weights.sum()), int(kinds.sum())
    least, room = 1 << 20, shape.looked_up
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= row["count"]
        if room < 0 or row["step"] < 0:
            break
        least = row["step"]
    frequent = sorted(((-r["times"], bytes(r["token"])) for r in counts.where(step >= least).collect()))
    tokens, times = [t for _, t in frequent], np.array([-n for n, _ in frequent], "i8")
    for token, n in list(zip(tokens, times))[:shape.head]:
        weights[crc32(token) % shape.buckets] -= n
        kinds[crc32(token) % shape.buckets] -= 1
    return Vocabulary(shape, tokens, times, total, distinct, weights, kinds), counts.where(step < least)


class LogBilinear:
    """A token's cell is predicted by the sum of the vectors before it, each through the matrix of its distance.

    ``inputs`` has a vector for each cell, and one more for the beginning of a text; ``outputs``
    and ``bias`` give the score of each cell from the sum.
    """

    NAMES = ("inputs", "outputs", "bias", "matrices")

    def __init__(self, shape: ModelShape, unigrams: np.ndarray):
        cells, rng = len(unigrams), np.random.default_rng(shape.seed)
        self.shape, self.unigrams = shape, unigrams
        self.inputs = rng.normal(0, 0.1, (cells + 1, shape.width)).astype("f4")
        self.outputs = rng.normal(0, 0.1, (cells, shape.width)).astype("f4")
        self.bias = np.log(unigrams).astype("f4")
        self.matrices = np.repeat(np.eye(shape.width, dtype="f4")[None], shape.context, axis=0)

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype("f8")

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at:at + old.size].reshape(old.shape).astype("f4"))
            at += old.size

    def log_probabilities(self, targets: np.ndarray, before: np.ndarray, rows: int = 512) -> np.ndarray:
        """Natural logarithms of the shares of the target cells, over all cells.

        Equal contexts are normalised once, ``rows`` at a time.
        """
        contexts, place = _distinct(before, len(self.inputs))
        weights = np.vstack([self.outputs.T, self.bias])  # the bias is one more component
        hidden = np.ones((len(contexts), len(weights)), "f4")
        hidden[:, :-1] = sum((self.inputs @ m)[contexts[:, k]] for k, m in enumerate(self.matrices))
        large = np.abs(hidden).max(initial=0) * np.abs(weights).sum(axis=0).max(initial=0) > 80
        if large:  # only then can an exponential overflow
            hidden, weights = hidden.astype("f8"), weights.astype("f8")
        ones, shift, totals = np.ones(weights.shape[1], weights.dtype), 0.0, np.empty(len(hidden))
        scores = np.empty((rows, weights.shape[1]), weights.dtype)
        for a in range(0, len(hidden), rows):
            found = np.matmul(hidden[a:a + rows], weights, out=scores[:len(hidden) - a])
            if large:
                shift = found.max(axis=1)
                found -= shift[:, None]
            totals[a:a + rows] = np.log((np.exp(found, out=found) @ ones).astype("f8")) + shift
        by_cell, out = np.ascontiguousarray(weights.T), -totals[place]
        for a in range(0, len(out), 1 << 13):
            part = slice(a, a + (1 << 13))
            out[part] += np.einsum("ij,ij->i", hidden[place[part]], by_cell[targets[part]])
        return out


def _distinct(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of numbers below ``size``, and for each row its place among them."""
    combinations = size ** rows.shape[1]
    if combinations >= 1 << 62:
        found, place = np.unique(rows, axis=0, return_inverse=True)
        return found, place.ravel()
    codes = rows[:, 0].astype("i8")
    for column in rows.T[1:]:
        codes *= size
        codes += column
    if combinations <= 1 << 20:  # a table of all combinations instead of a sort
        table = np.zeros(combinations, "i4")
        table[codes] = 1
        found = np.flatnonzero(table)
        table[found] = np.arange(len(found))
        place = table[codes]
    else:
        found, place = np.unique(codes, return_inverse=True)
    columns = []
    for _ in range(rows.shape[1]):
        found, column = np.divmod(found, size)
        columns.insert(0, column)
    return np.stack(columns, axis=1), place


def _added(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by their index."""
    width = rows.shape[1]
    places = index.astype("i8")[:, None] * width + np.arange(width)
    return np.bincount(places.ravel(), rows.ravel(), size * width).reshape(size, width).astype("f4")


def _share(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in the place of x."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive steps on a model, their sizes by AdaGrad.

    Every token of a batch is told apart from the same ``noise`` samples of the unigram
    shares: the odds that a token came from the corpus are its score against
    the noise's.
    """

    def __init__(self, model: LogBilinear, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(model.shape.noise * model.unigrams).astype("f4")
        self.bounds = np.cumsum(model.unigrams)
        self.squares = {n: np.full(getattr(model, n).shape, 1e-6, "f4") for n in model.NAMES}

    def _move(self, name: str, gradient: np.ndarray) -> None:
        squares = self.squares[name]
        squares += gradient * gradient
        value = getattr(self.model, name)
        value -= self.model.shape.rate * gradient / np.sqrt(squares)

    def step(self, targets: np.ndarray, before: np.ndarray) -> None:
        m, n = self.model, len(targets)
        noise = np.minimum(np.searchsorted(self.bounds, self.rng.random(m.shape.noise)), len(self.bounds) - 1)
        hidden = sum((m.inputs @ c)[before[:, k]] for k, c in enumerate(m.matrices))
        out_true, out_noise = m.outputs[targets], m.outputs[noise]
        # Slopes of the logistic loss: minus the share of noise for the true ones, the share of the corpus for the others.
        true = -_share(np.einsum("ij,ij->i", hidden, out_true) + (m.bias - self.log_noise)[targets])
        false = hidden @ -out_noise.T
        false += (self.log_noise - m.bias)[noise]
        false = _share(false)
        back = true[:, None] * out_true + false @ out_noise
        hidden, from_noise = true[:, None] * hidden, false.T @ hidden
        outputs, bias = _added(targets, hidden, len(m.outputs)), np.bincount(targets, true, len(m.bias)).astype("f4")
        np.add.at(outputs, noise, from_noise)
        np.add.at(bias, noise, false.sum(axis=0))
        # Slopes are added up by cell before they go through the matrices: there are fewer cells than tokens.
        by_cell = [_added(before[:, k], back, len(m.inputs)) for k in range(m.shape.context)]
        matrices = np.stack([m.inputs.T @ found for found in by_cell])
        inputs = sum(found @ c.T for found, c in zip(by_cell, m.matrices))
        for name, gradient in (("outputs", outputs), ("bias", bias), ("matrices", matrices), ("inputs", inputs)):
            self._move(name, gradient / n)

    def learn(self, targets: np.ndarray, before: np.ndarray) -> None:
        """A step for each batch, of tokens drawn from everywhere in the block."""
        order, batch = self.rng.permutation(len(targets)), self.model.shape.batch
        targets, before = targets[order], before[order]
        for a in range(0, len(order), batch):
            self.step(targets[a:a + batch], before[a:a + batch])


def blocks(texts: Iterator[tuple[int, str | None]], reader: Reader, context: int, size: int = 1 << 15) -> Iterator[tuple]:
    """(pieces, numbers, cells, cells before, tokens not looked up) of consecutive tokens, in blocks of ``size`` or more.

    A block holds whole texts, or pieces of a long one: ``pieces`` has the place of each and its first token, the last list (place, tokens).
    """
    start = int(reader.cell.max()) + 1
    parts, pieces, rare, held = [], [], [], 0

    def done() -> tuple:
        return (np.array(pieces).T, *(np.concatenate(p) for p in zip(*parts)), rare)

    for place, text in texts:
        last = np.full(context, start, "i4")
        for words in token_pieces(text):
            numbers = reader.numbers(words)
            cells = reader.cell[numbers]
            row = np.concatenate([last, cells])
            n = len(cells)
            before = np.stack([row[context - 1 - k:context - 1 - k + n] for k in range(context)], axis=1)
            last = row[n:]
            unknown = np.flatnonzero(numbers >= reader.known).tolist()
            if unknown:
                rare.append((place, [words[k] for k in unknown]))
            parts.append((numbers, cells, before))
            pieces.append((place, held))
            held += n
            if held >= size:
                yield done()
                parts, pieces, rare, held = [], [], [], 0
    if parts:
        yield done()


def train(texts: DataFrame, vocabulary, model: LogBilinear) -> LogBilinear:
    """One round: every task learns from its texts, starting with ``model``; the models are averaged by their tokens.

    ``texts`` has the column text. A task hands on one vector of all parameters;
    these are added up in two steps, as streams, and the last eight on the driver.
    """
    start, shape = model, model.shape

    def learnt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(vocabulary.value)
        mine = LogBilinear(shape, start.unigrams)
        mine.unpack(start.packed())
        trainer, tokens = None, 0
        texts = ((0, t) for frame in frames for t in frame["text"])
        for _, numbers, cells, before, _ in blocks(texts, reader, shape.context):
            trainer = trainer or Trainer(mine, crc32(numbers.tobytes()))
            trainer.learn(cells, before)
            tokens += len(cells)
        if tokens:
            yield pd.DataFrame({"tokens": [float(tokens)], "sums": [(mine.packed() * tokens).tobytes()]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, sums = 0.0, 0.0
        for frame in frames:
            for n, values in zip(frame["tokens"], frame["sums"]):
                tokens, sums = tokens + n, sums + np.frombuffer(values)
        if tokens:
            yield pd.DataFrame({"tokens": [tokens], "sums": [sums.tobytes()]})

    schema = "tokens double, sums binary"
    parts = texts.select("text").mapInPandas(learnt, schema)
    for tasks in (64, 8):
        parts = parts.repartition(tasks, F.xxhash64("sums")).mapInPandas(added, schema)
    found = parts.collect()
    model = LogBilinear(shape, start.unigrams)
    model.unpack(sum(np.frombuffer(r["sums"]) for r in found) / sum(r["tokens"] for r in found) if found else start.packed())
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, shape: ModelShape = ModelShape()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between white space (A to Z lower-cased) and one end behind
    the last. Counts and model are learnt from all rows whose id's checksum is
    no multiple of ``folds``. ``base_score`` sums log10 of the raised shares of the
    tokens in the corpus. ``score`` sums log10 of the model's shares: that of the
    token's cell, normalised over all cells, times that of the token among the
    raised counts of its cell, where one unseen token has a place too. So the
    shares of all tokens and an unseen one for each bucket add up to one.

    Missing and empty texts are an end alone. A row without an id is scored but
    not learnt from, and its ``held_out`` is missing. Rows alike score alike and
    count as often as they occur. Without any row to learn from, all counts are
    zero and the model knows its buckets only. An empty table stays empty. No
    column but id and text is read. Long texts are read in pieces of 1 MB.

    Counts of tokens that are not looked up are joined with the tokens of the
    documents; adaptive execution can split a token that many documents share, as
    counts have it once. Tasks learn apart, so another partitioning gives slightly
    different scores; counts and base scores are the same.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    read = docs.select(as_col(id_col).alias("doc_id"), as_col(text_col).alias("text"), held_out(id_col, folds).alias("held_out"))
    learning = read.where("NOT held_out")
    counts = settle(token_counts(learning), "counts")
    vocabulary, others = build_vocabulary(counts, shape)
    shared = spark.sparkContext.broadcast(vocabulary)
    model = LogBilinear(shape, vocabulary.unigrams)
    for turn in range(shape.rounds):
        model = train(learning.where(F.pmod(F.xxhash64("text"), F.lit(shape.rounds)) == turn), shared, model)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        known = np.concatenate([np.ones(reader.known, "i8"), np.zeros(shape.buckets, "i8")])
        # Long blocks, as equal contexts are normalised once in a block.
        for frame in small_batches(frames, 1024):
            rows = len(frame)
            sums = {name: np.zeros(rows) for name in ("n_tokens", "n_known", "base_score", "score")}
            rare: list[list[bytes]] = [[] for _ in range(rows)]
            for (places, first), numbers, cells, before, unknown in blocks(enumerate(frame["text"]), reader, shape.context, 1 << 18):
                chances = model.log_probabilities(cells, before) / np.log(10) + reader.within[numbers]
                np.add.at(sums["n_tokens"], places, np.diff(first, append=len(cells)))
                for name, values in (("n_known", known[numbers]), ("base_score", reader.base[numbers]), ("score", chances)):
                    np.add.at(sums[name], places, np.add.reduceat(values, first))
                for k, tokens in unknown:
                    rare[k] += tokens
            yield pd.DataFrame({
                "row": frame["row"].to_numpy(), "doc_id": frame["doc_id"].to_numpy(), "held_out": frame["held_out"].to_numpy(),
                "n_tokens": sums["n_tokens"].astype("i8"), "n_known": sums["n_known"].astype("i8"),
                "base_score": sums["base_score"], "score": sums["score"],
                # A blank before each token; no token holds one.
                "rare": [b" " + b" ".join(found) if found else None for found in rare]})

    parts = settle(read.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        scored, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
                "rare binary"), "scored")
    words = F.split(F.substr(F.col("rare").cast("string"), F.lit(2)), " ").cast("array<binary>")
    tokens = parts.where("rare IS NOT NULL").select("row", F.explode(words).alias("token"))
    added = tokens.join(others, "token", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("times", F.lit(0)) + F.lit(ADDED))).alias("added"), F.count("times").alias("more_known"))
    return parts.drop("rare").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        *((F.col(c) + F.coalesce("added", F.lit(0.0))).alias(c) for c in ("base_score", "score")))
