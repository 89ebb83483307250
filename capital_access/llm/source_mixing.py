"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import fresh_names, row_key
from capital_access.session import settle

#: A mean above this is drawn as a sum of independent draws of smaller mean, as exp(-mean) must not vanish.
_MEAN_PER_DRAW = 16.0
#: Steps of the distribution function: beyond them lies less than 2 ** -60 for the mean of a draw.
_STEPS = 80


def hashed(*parts) -> Column:
    """Hexadecimal digest of the parts, joined by colons; a missing part counts as ``null``."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def uniform(digest: Column) -> Column:
    """52 bits of a hexadecimal digest as a number from 0 up to 1."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Probabilities of at most 0, 1, 2, ... events, as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, lambda acc: acc["cdf"])


def poisson_count(cdf: Column, draws: Column, *key) -> Column:
    """The sum of ``draws`` Poisson numbers, each the inverse of the distribution at a number hashed from the key."""
    numbers = F.transform(F.sequence(F.lit(1), draws), lambda k: uniform(hashed(*key, k)))
    return F.aggregate(F.transform(numbers, lambda u: F.size(F.filter(cdf, lambda c: c <= u))), F.lit(0), lambda acc, n: acc + n)


def repetition_rates(docs: DataFrame, source_col: str, text_col: str, weights: Mapping[str | None, float] | None = None,
                     temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """Rows (mix_source, rate): how often a document of the source must occur for the sources to get their weights.

    The size of a source is its characters (an empty text counts as one). The
    whole is ``epochs`` times the size of all. A source gets the share of its
    weight among the weights of the sources present; without ``weights`` that is
    its size to the power ``temperature``. With ``weights``, a source that is not
    among them gets rate 1 and stays out of the shares.
    """
    sizes = settle(
        docs.groupBy(as_col(source_col).alias("mix_source"))
        .agg(F.sum(F.greatest(F.length(as_col(text_col)), F.lit(1))).alias("size")), "sizes")  # greatest() skips a missing length
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(None).cast("double")
        for source, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    whole = weighed.where("weight IS NOT NULL").agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    share = F.col("weight") / F.lit(whole["all_weight"]).cast("double")
    rate = share * F.lit(epochs) * F.lit(whole["all_size"]).cast("double") / F.col("size")
    return weighed.select("mix_source", F.when(F.col("weight").isNull(), F.lit(1.0)).otherwise(rate).alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each repeated a Poisson number of times with its source's rate as mean, in random order.

    Adds ``copy`` (1, 2, ...) and ``shuffle_key``, by which the rows are sorted
    over all partitions; a name that ``docs`` has already gets a ``_`` behind
    it. The numbers and the order are hashed from the seed and the id, so they
    are the same on every run and for every retry of a task. Rows of the same id
    are repeated alike; those without an id too. A missing source is a source.
    Missing and empty texts are repeated like others. An empty table stays empty.

    Everything is a column expression. Rates are one row per source, written
    before the join: Spark broadcasts them as long as they are small, and
    otherwise can split the source that holds a third of all rows.
    """
    rates = settle(
        repetition_rates(docs, source_col, text_col, weights, temperature, epochs)
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / _MEAN_PER_DRAW)).cast("int"))
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws"))), "rates")
    names = fresh_names(docs, "mix_source", "rate", "draws", "cdf", "copy", "shuffle_key")
    source, _, draws, cdf, copy, order = names
    joined = docs.join(rates.toDF(*names[:4]), as_col(source_col).eqNullSafe(F.col(source)))
    count = poisson_count(F.col(cdf), F.col(draws), seed, as_col(id_col))
    return (
        joined.withColumn(copy, F.explode(F.filter(F.sequence(F.lit(0), count), lambda k: k > 0)))
        .withColumn(order, hashed(f"{seed}-order", as_col(id_col), F.col(copy)))
        .select(*map(as_col, docs.columns), copy, order).orderBy(order, row_key(id_col, text_col)))
