"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate, its target rows over its own rows. A document's count is the
Poisson quantile of a uniform number hashed from the seed and its id, so it can be recomputed by any
executor in any order. A rate over 64 is cut into equal parts of at most 64, each with a hashed number of
its own: a sum of independent Poisson counts is the Poisson count of the summed rates. The cumulative
probabilities are worked out once a source and joined back; documents are exploded by their counts and shuffled
globally by a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_parts

#: The highest rate of one Poisson part; and how often a caller's ``total`` may repeat the whole table on average.
MAX_RATE = 64.0
#: Up to so many sources, one short row each, are broadcast; beyond that the join is shuffled and salted.
BROADCAST_SOURCES = 20_000
SALTS = 32


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from 52 hashed bits; null keys hash as a word of their own."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def last_term(rate: float) -> int:
    """A count above which less than 2**-53 of the mass lies."""
    k, p, left = 0, math.exp(-rate), 1.0 - math.exp(-rate)
    while left > 2.0**-53 and k < 1000:
        k += 1
        p *= rate / k
        left -= p
        if k > rate and p < 2.0**-60:
            break
    return k


def cumulated(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, 2, ... of a Poisson count, as far as a double tells them from 1."""
    most = F.least(F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int"), F.lit(last_term(MAX_RATE)))
    begin = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), F.concat(acc["all"], F.array(acc["cdf"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most - 1), begin, step, lambda acc: acc["all"])


def poisson_quantile(u: Column, cdf: Column) -> Column:
    """The number of values at which the cumulative probability is at most ``u``, which is worked out once."""
    return F.element_at(F.transform(F.array(u), lambda x: F.size(F.filter(cdf, lambda c: c <= x))), 1)


def parts_of(rate: Column) -> tuple[Column, Column]:
    """Into how many parts a rate is cut, and the rate of each, at most ``MAX_RATE``."""
    parts = F.greatest(F.ceil(rate / MAX_RATE).cast("int"), F.lit(1))
    return parts, rate / parts


def poisson_count(seed: int, key: Column, parts: Column, cdf: Column) -> Column:
    """The sum of the Poisson counts of ``parts`` parts with the probabilities ``cdf``, hashed independently."""
    rest = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, k: n + poisson_quantile(uniform(seed, key, F.lit("part"), k), cdf))
    return poisson_quantile(uniform(seed, key), cdf) + F.when(parts > 1, rest).otherwise(F.lit(0))


def rates(df: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", total: float | None = None) -> DataFrame:
    """``source``, ``rows`` and mean ``rate`` of every source (null is a source of its own).

    ``weights`` are relative; a source without one gets 0 if others have one. Without ``weights`` all sources
    weigh the same. ``total`` is the number of rows wanted, by default as many as there are.
    """
    src = F.coalesce(F.col(source_col).cast("string"), F.lit("\0null"))
    stats = df.groupBy(src.alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    w = F.lit(1.0)
    if weights is not None:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("__source") == ("\0null" if name is None else name), F.lit(float(value))).otherwise(w)
    stats = stats.withColumn("__w", w)
    sums = stats.agg(F.sum("__w").alias("__all"), F.sum("__rows").alias("__n"))
    want = F.lit(float(total)) if total is not None else F.col("__n").cast("double")
    rate = F.when(F.col("__w") == 0, F.lit(0.0)).otherwise(F.col("__w") * want / F.col("__all") / F.col("__rows"))
    return stats.crossJoin(F.broadcast(sums)).select("__source", "__rows", rate.alias("__rate"))  # one row of sums


def mix(df: DataFrame, weights: dict[str, float] | None = None, *, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", total: float | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``df`` repeated to the target weights and shuffled globally, with ``copy`` and ``shuffle_key``.

    ``copy`` counts from 0 within a document; ``shuffle_key`` is uniform in [0, 1), deals the rows out to
    partitions at random and orders them within. Rows that share an id share a count. Null ids, sources and texts are values like
    any other; empty input gives empty output; columns named as the two new ones are replaced, no other column is
    touched, whatever its name. A source's rate has no bound; only a ``total`` that repeats the whole table more than ``max_rate`` times on average is refused,
    as most likely a mistake. Only one row per source is aggregated and joined back.
    """
    parts, share = parts_of(F.col("__rate"))
    r = rates(df, weights, source_col=source_col, total=total).select("__source", "__rows", parts.alias("__parts"), share.alias("__share"))
    r = cut(r.select("__source", "__rows", "__parts", cumulated(F.col("__share")).alias("__cdf")))  # one short array a source
    if total is not None and total > max_rate * (r.agg(F.sum("__rows")).first()[0] or math.inf):
        raise ValueError(f"all rows would be repeated more than {max_rate} times on average")
    kept = df.drop("copy", "shuffle_key")
    free = lambda name: name if name not in kept.columns else free("_" + name)  # noqa: E731  no column of the input is lost
    source, cdf, parts, salt, n = map(free, ("__source", "__cdf", "__parts", "__salt", "__n"))
    r = r.select(F.col("__source").alias(source), F.col("__parts").alias(parts), F.col("__cdf").alias(cdf))
    keyed = kept.withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")))
    if r.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(r), source)
    else:  # a source may hold a third of all rows: salt it
        salts = F.array(*[F.lit(i) for i in range(SALTS)])
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(r.withColumn(salt, F.explode(salts)), [source, salt]).drop(salt)
    counted = joined.withColumn(n, poisson_count(seed, F.col(id_col), F.col(parts), F.col(cdf))).drop(source, parts, cdf).filter(F.col(n) > 0)
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    shuffled = out.withColumn("shuffle_key", uniform(seed + 1, F.col(id_col), F.col("copy")))
    return shuffled.repartition(shuffle_parts(df), "shuffle_key").sortWithinPartitions("shuffle_key", id_col, "copy")
