"""Connected components of links, and all pairs of strings at most two edits apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.scratch import drop, keep

EDITS = 2
SEGMENTS = EDITS + 1
FEW_EDGES, FEW_FILES = 500_000, 6  # edges that are written as few files


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps, each a few shuffles of the edges; the
    steps grow with the logarithm of the largest component, and each writes its edges,
    so that lost executors cost one step; few edges are written as few files. Self links, repeated rows and nulls are dropped.
    """
    compact = lambda df, rows: df.coalesce(FEW_FILES) if rows <= FEW_EDGES else df  # noqa: E731  edges don't grow in number
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, rows = None, now.count()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        after = keep(compact(small.distinct(), rows), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if seen == mark:
            break
        mark, rows = seen, seen[0]
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", F.col("b").alias("component")).distinct())


def near_pairs(rows: DataFrame, value: str, by: list[str], least: int) -> DataFrame:
    """(*by, one, other), one < other: all pairs of different values, of least characters or more, at most EDITS edits apart, within by.

    The shorter value of such a pair is cut into SEGMENTS even pieces. Edits touch all but
    one of them at most, so one stands in the other value, moved by EDITS characters at
    most: values are indexed by their own pieces, and look up the pieces that values of
    nearly their length may have. Only pairs that share a piece meet, and AQE splits
    frequent pieces; the distance is part of the join's condition.
    """
    known = rows.select(*by, F.col(value).alias("value")).where(F.char_length("value") >= least).distinct()
    cut = lambda n, i: F.floor(n * i / SEGMENTS).cast("int")
    sized = known.withColumn("n", F.char_length("value")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    own = sized.withColumn("start", cut(F.col("n"), F.col("piece"))).withColumn("size", cut(F.col("n"), F.col("piece") + 1) - F.col("start"))
    own = own.select(*by, F.col("value").alias("one"), "n", "piece", F.expr("substring(value, start + 1, size)").alias("part"))
    wide = sized.withColumnRenamed("n", "own_n").withColumn("n", F.explode(F.sequence(F.greatest(F.lit(least), F.col("own_n") - EDITS), F.col("own_n"))))
    wide = wide.withColumn("start", cut(F.col("n"), F.col("piece"))).withColumn("size", cut(F.col("n"), F.col("piece") + 1) - F.col("start"))
    wide = wide.withColumn("shift", F.explode(F.sequence(F.lit(-EDITS), F.lit(EDITS)))).withColumn("at", F.col("start") + F.col("shift")).where("at >= 0 and at + size <= own_n")
    asked = wide.select(*by, F.col("value").alias("other"), "n", "piece", F.expr("substring(value, at + 1, size)").alias("part"))
    found = own.join(asked, [*by, "n", "piece", "part"]).where((F.col("one") != F.col("other")) & (F.levenshtein("one", "other", EDITS) >= 0))
    return found.select(*by, F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct()
