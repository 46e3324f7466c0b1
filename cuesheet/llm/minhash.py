"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's signature is POSITIONS minimum hashes of its word shingles, 16 bits of
each. Two sets of similarity s differ at a position with probability 1 - s, so the
distance of a pair at the threshold is binomial; the distance bound is the one that
such a pair exceeds once in 10**9 times, and a more similar one still more rarely. The signature is split into chunks, more than
half the bound: by the pigeonhole principle a pair within the bound has a chunk with
at most one error. A chunk with c positions is therefore indexed c times, each time
with another position left out (the enumerated error), and every pair within the
bound meets under at least one key. Candidates are confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.scratch import drop, keep

from . import textkit
from .components import link

POSITIONS = 64
MISS = 1e-9
_SEEDS = textkit.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64))
_FACTORS = textkit.mix(np.arange(1001, 1001 + POSITIONS, dtype=np.uint64)) | np.uint64(1)


def distance_bound(similarity: float, positions: int = POSITIONS, miss: float = MISS) -> int:
    """The smallest distance that a pair of this similarity exceeds with probability below miss."""
    differ, tail = 1 - similarity, 1.0
    for d in range(positions + 1):
        tail -= math.comb(positions, d) * differ**d * similarity ** (positions - d)
        if tail < miss:
            return d
    return positions


def chunks(bound: int, positions: int = POSITIONS) -> list[range]:
    """Even chunks, so many that a pair within the bound has one with at most one error."""
    n = min(positions // 2, bound // 2 + 1)
    cuts = [positions * i // n for i in range(n + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signature(unique: np.ndarray) -> np.ndarray:
    best = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(unique), 4096):
        block = (unique[at : at + 4096, None] ^ _SEEDS) * _FACTORS
        np.minimum(best, block.min(axis=0), out=best)
    return (textkit.mix(best) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(start, sets) for pieces of the rows, small enough that a worker needs little memory."""
    for start, part in textkit.slices(column, 1 << 19):
        made, offsets = textkit.shingles(*textkit.words(part), k)
        yield start, [np.unique(made[offsets[i] : offsets[i + 1]]) for i in range(len(part))]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _signed(k: int):
    def total(values: np.ndarray) -> int:
        return int(textkit.mix(values).sum(dtype=np.uint64).view(np.int64))

    def run(batches):
        for batch in batches:
            for start, sets in _sets(batch.column(1), k):
                columns = [
                    batch.column(0).slice(start, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array([total(x) for x in sets], pa.int64()),
                    pa.array([total(x ^ np.uint64(0x5851F42D4C957F2D)) for x in sets], pa.int64()), _lists([_signature(x) for x in sets], pa.int16()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for start, sets in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), _lists([x.view(np.int64) for x in sets], pa.int64())], ["id", "items"])

    return run


def distance(a: Column, b: Column) -> Column:
    """Positions at which two signatures differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def index_keys(signature: Column, bound: int) -> Column:
    """The array of a signature's index keys: each chunk with each position left out."""
    keys = []
    for i, chunk in enumerate(chunks(bound)):
        for left_out in chunk:
            keys.append(F.xxhash64(F.lit(i * 1000 + left_out), *[signature[p] for p in chunk if p != left_out]))
    return F.array(*keys)


class ShinglePairing:
    """Links of shingle sets: nodes (id, n_shingles, signature) with texts (id, text)."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, shingle: int, percent: int, bound: int):
        self.texts, self.nodes, self.shingle, self.percent, self.bound = texts, nodes, shingle, percent, bound

    def _sided(self, pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(table.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return pairs

    def meet(self, ids: DataFrame) -> None:
        wanted = self.texts.join(ids, "id", "left_semi").mapInArrow(textkit.tidy(_full_sets(self.shingle)), "id long, items array<bigint>")
        self.sets = keep(wanted.where(F.size("items") > 0), "sets")

    def near(self, pairs: DataFrame) -> DataFrame:
        rows = self._sided(pairs, self.nodes, ["n_shingles", "signature"])
        fits = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * self.percent
        return rows.where(fits & (distance(F.col("signature_a"), F.col("signature_b")) <= self.bound)).select("a", "b").distinct()

    def narrow(self, members: DataFrame) -> DataFrame:
        """A set can only have a link to another part if percent of its shingles occur in other parts at all."""
        each = self.sets.join(members, "id").select("id", "part", F.explode("items").alias("item"))
        mixed = each.groupBy("item").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("item")
        common = each.select("id", "item").join(mixed, "item").groupBy("id").agg(F.count(F.lit(1)).alias("common"))
        sized = self.nodes.select("id", "n_shingles").join(common, "id")
        return sized.where(F.col("common") * 100 >= F.col("n_shingles") * self.percent).select("id")

    def deltas(self, rows: DataFrame) -> DataFrame:
        both = rows.join(self.sets, "id").join(self.sets.select(F.col("id").alias("pivot"), F.col("items").alias("given")), "pivot")
        return both.select("pivot", "id", F.size("items").alias("size"), F.size("given").alias("pivot_size"), F.array_except("items", "given").alias("added"), F.array_except("given", "items").alias("missing"))

    def _enough(self, both: Column, one: Column, two: Column) -> Column:
        return both * 100 >= (one + two - both) * self.percent

    def linked_to_pivot(self) -> Column:
        return self._enough(F.col("size") - F.size("added"), F.col("size"), F.col("pivot_size"))

    @property
    def unit(self) -> int:
        return 2 * (100 + self.percent)

    def need(self) -> Column:
        """Two sets share |pivot| - missing - missing + common differences; a link asks for percent of the sizes over 100 + percent."""
        return 2 * self.percent * F.col("size") + self.unit * F.size("missing") - (100 + self.percent) * F.col("pivot_size")

    def linked(self, one: str, two: str) -> Column:
        """What two sets share is what both add to the pivot, and the pivot without what either misses. Bounds from sizes come first."""
        col = lambda prefix, name: F.col(prefix + name)
        sizes = [col(p, "size") for p in (one, two)]
        missing, added = ([F.size(col(p, name)) for p in (one, two)] for name in ("missing", "added"))
        rest = col(two, "pivot_size") - missing[0] - missing[1]
        most = rest + F.least(*added) + F.least(*missing)
        shared = rest + F.size(F.array_intersect(col(one, "added"), col(two, "added"))) + F.size(F.array_intersect(col(one, "missing"), col(two, "missing")))
        return self._enough(F.least(most, *sizes), *sizes) & self._enough(shared, *sizes)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("items_a", "items_b"))
        rows = self._sided(pairs, self.sets, ["items"]).withColumn("both", both)
        return rows.where(F.col("both") * 100 >= (F.size("items_a") + F.size("items_b") - F.col("both")) * self.percent).select("a", "b").distinct()


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked when 100 * common shingles >= percent * all shingles of the
    two. n_shingles is the size of a document's set of distinct word shingles;
    component_id the smallest doc_id reachable over links, itself included; kept marks
    that document. Words are runs without ASCII white space, A-Z lower-cased; a text of
    fewer words is one shingle. Null, empty and blank texts have empty sets and no links.
    Rows that share a doc_id count as one document, linked as any of their texts is. A
    null doc_id is linked with nothing: its component_id is null and it is kept. Texts
    are used whole, whatever their length. Other columns are ignored.

    Equal sets are first reduced to one representative, so copies cost no pairs.
    """
    bound = distance_bound(percent / 100)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = keep(texts.mapInArrow(textkit.tidy(_signed(shingle)), "doc_id long, n_shingles long, d1 long, d2 long, signature array<smallint>"), "signed")
    same = ["n_shingles", "d1", "d2"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    groups = full.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.any_value("signature").alias("signature"))
    groups = keep(groups, "groups")
    members = full.join(groups.select(*same, "first_id"), same).select("doc_id", "first_id").distinct()

    nodes = groups.select(F.col("first_id").alias("id"), "n_shingles", "signature")
    keyed = nodes.select(F.explode(index_keys(F.col("signature"), bound)).alias("key"), "id")
    shared = members.groupBy("doc_id").agg(F.min("first_id").alias("lo"), F.max("first_id").alias("hi")).where("lo < hi").select("doc_id", "lo")
    twins = members.join(shared, "doc_id").select(F.col("lo").alias("a"), F.col("first_id").alias("b"))
    pairing = ShinglePairing(texts, nodes, shingle, percent, bound)
    parts = link(keyed, pairing, twins)
    rooted = parts.select(F.col("id").alias("first_id"), "component")
    placed = members.join(rooted, "first_id", "left").select("doc_id", F.coalesce("component", "first_id").alias("component_id"))
    placed = keep(placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "placed")
    result = signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    drop(pairing.sets)
    drop(groups)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of near_components, that of its smallest doc_id, and all rows of no group.

    Rows whose doc_id is null or occurs again are documents of their own: a hash of doc_id
    and text stands in for their doc_id, and of rows equal in both one stays. Null ids
    come after all others. Blank texts have no group, so they go only as such repeats.
    All columns of docs are kept, whatever their names; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    own, body = F.col("doc")[doc_id].cast("long"), F.col("doc")[text]
    odd = keep(rows.groupBy(own.alias("odd_id")).agg(F.count(F.lit(1)).alias("n")).where("odd_id is null or n > 1").select("odd_id"), "odd")
    n_odd = odd.limit(1_000_001).count()
    again = odd.where("odd_id is not null")
    marked = rows.join(F.broadcast(again) if n_odd <= 1_000_000 else again, own == F.col("odd_id"), "left")
    marked = marked.withColumn("own", own).withColumn("odd", F.col("own").isNull() | F.col("odd_id").isNotNull())
    keyed = marked.select("doc", "own", "odd", F.when(F.col("odd"), F.xxhash64("own", body)).otherwise(F.col("own")).alias("row"))

    parts = near_components(keyed.select("row", body.alias("text")), "row", "text", shingle, percent)
    if not n_odd:
        gone = keep(parts.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
        return rows.join(gone, own == F.col("gone"), "left_anti").select("doc.*")
    named = keyed.where("odd").select("row", "own", F.lit(True).alias("named")).distinct()
    placed = parts.select(F.col("doc_id").alias("row"), "component_id").distinct().join(named, "row", "left")
    first = F.when(F.col("named"), F.col("own")).otherwise(F.col("row"))
    placed = keep(placed.select("row", "component_id", F.struct(first.isNull().alias("none"), first.alias("own"), "row").alias("rank")), "placed")
    heads = placed.groupBy("component_id").agg(F.min("rank").alias("head")).select(F.col("head.row").alias("row"))
    gone = keep(placed.join(heads, "row", "left_anti").select("row"), "gone")
    drop(placed)
    rest = keyed.join(gone, "row", "left_anti")
    once = rest.where("odd").groupBy("row").agg(F.min("doc").alias("doc"))
    return rest.where("not odd").select("doc.*").union(once.select("doc.*"))
