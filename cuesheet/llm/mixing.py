"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every document gets a count drawn from a Poisson distribution whose mean is its
source's target repetition rate: the distribution is inverted at a uniform number
hashed from the seed and doc_id (without one, the text), so a run repeats exactly,
wherever its tasks run.
A mean above MAX_RATE is the sum of equal parts of at most MAX_RATE, each drawn at its
own uniform number: Poisson counts add exactly, so no rate is cut.
The document is exploded by its count, and all copies are shuffled globally: their
hashed sort keys are uniform, so a key says which of the ordered partitions it belongs to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX52 = 13  # hex digits in the 52 bits of a uniform number
MAX_RATE = 64.0  # of one part; larger rates are drawn in several parts
KEY_BITS = 60
ROWS_PER_PARTITION = 50_000


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform number in [0, 1): 52 bits of the MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX52), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: float = MAX_RATE) -> int:
    """Terms after which a Poisson distribution of this mean has less than 2**-52 left."""
    return math.ceil(rate + 12 * math.sqrt(rate) + 24)


def poisson_cdf(rate: Column) -> Column:
    """The distribution's values at 0, 1, 2, ... below 1, up to where they don't grow any more, as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), F.concat(acc["cdf"], F.array(acc["total"] + term)).alias("cdf"))

    values = F.aggregate(F.sequence(F.lit(1), F.lit(poisson_steps())), start, step, lambda acc: acc["cdf"])
    return F.filter(F.array_distinct(values), lambda c: c < 1)


def target_rates(docs: DataFrame, source: str = "source", power: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate) for every source.

    rate = epochs * all documents * weight / sum of weights / documents of the source,
    however large. Without given weights a source weighs its size to the given
    power: 1 keeps the mix, 0 makes all sources equal. Given weights hold as they
    are; a source that they don't name gets 0. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.sqrt(F.col("n_docs").cast("double")) if power == 0.5 else F.pow(F.col("n_docs").cast("double"), F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    all_docs, all_weight = sizes.agg(F.sum("n_docs"), F.sum("weight")).first()
    rate = F.lit(epochs * (all_docs or 0)) * F.col("weight") / F.lit(all_weight or 1.0) / F.col("n_docs")
    return sizes.select("source", "n_docs", rate.alias("rate"))


def _at_most(cdf: Column, u: Column) -> Column:
    """The count at the uniform number u: how many of the distribution's values are at most u."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def row_name(doc_id: Column, text: Column) -> Column:
    """What a row's draws are hashed from: its doc_id, or the MD5 of its text where that is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", power: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17, broadcast_sources: int = 10_000) -> DataFrame:
    """All copies of all documents: docs' columns, mix_copy (from 1) and mix_key, ordered by mix_key.

    The rates are one row a source; they are broadcast only after a count shows at
    most broadcast_sources of them, otherwise Spark joins by source. Rows of one doc_id
    draw equal counts; rows without one draw by their text, so equal ones draw alike.
    Copies of equal mix_key, such as those of repeated rows, come in any order.
    Empty tables give empty results. Columns of docs named mix_copy or mix_key are
    replaced, others are kept, whatever their names; texts of any length are only passed on.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE)).cast("int"))
    rates = target_rates(docs, source, power, weights, epochs).withColumn("parts", parts)
    made = rates.agg(F.sum(F.col("n_docs") * F.col("rate"))).first()[0] or 0
    rates = rates.select(F.col("source").alias("of_source"), "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf"))
    few = docs.select(source).distinct().limit(broadcast_sources + 1).count() <= broadcast_sources
    kept = docs.drop("mix_copy", "mix_key")
    own = lambda c: F.col("doc")[c]
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("doc"))
    joined = rows.join(F.broadcast(rates) if few else rates, own(source).eqNullSafe(F.col("of_source")))
    joined = joined.withColumn("name", row_name(own(doc_id), own(text)))
    others = F.transform(F.sequence(F.lit(2), F.col("parts")), lambda part: uniform(seed, F.col("name"), part))
    others = F.aggregate(others, F.lit(0), lambda n, u: n + _at_most(F.col("cdf"), u))
    others = F.when(F.col("parts") > 1, others).otherwise(0)
    counted = joined.withColumn("u", uniform(seed, F.col("name"))).withColumn("n", _at_most(F.col("cdf"), F.col("u")) + others)
    copies = counted.where("n > 0").select("doc", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("mix_copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), "name", F.col("mix_copy").cast("string")))
    copies = copies.select("doc", "mix_copy", F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("mix_key"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / ROWS_PER_PARTITION))
    at = F.shiftright(F.shiftright("mix_key", KEY_BITS - 30) * F.lit(ranges), 30).cast("int")
    ordered = copies.repartitionById(ranges, at).sortWithinPartitions("mix_key")
    return ordered.select(*[own(c).alias(c) for c in kept.columns], "mix_copy", "mix_key")
