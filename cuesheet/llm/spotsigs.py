"""SpotSigs document fingerprints.

A signature is an anchor, one of the common words below, with the chain of the next
CHAIN content words (words that are no anchors) after it. A document's fingerprint is
the set of its signatures, 32 bits of a hash each. Sets are compared by Jaccard
similarity, pruned by their lengths; near-duplicate search partitions them by length.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.scratch import drop, keep

from . import textkit
from .components import link
from .minhash import ShinglePairing

CHAIN = 2
ROWS_PER_RANGE = 20_000
# Common words of English, German, French and Spanish.
ANCHORS = """
a an the and or of to in on at by for from with is are was were be been it this that as but not have has had he she they we you his her its their
der die das ein eine einer eines dem den des und oder von zu im in auf mit für ist sind war als auch nicht es sie er wir aus bei nach dass sich
le la les un une des du de et ou en dans sur par pour avec est sont que qui ne pas ce cette il elle nous vous au aux se son sa ses
el los las unos unas del al y o por para con como es son fue se su sus lo que no más este esta ese esa
""".split()
_ANCHORS = np.sort(textkit.letters(pa.array([" ".join(sorted(set(ANCHORS)))], pa.large_string()))[0])
U = np.uint64


def fingerprints(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct signatures of each row, as uint32.

    A row without signatures has one for all its words, a row without words one for its
    text; an empty or null row has none.
    """
    hashes, offsets = textkit.letters(column)
    at = np.minimum(np.searchsorted(_ANCHORS, hashes), len(_ANCHORS) - 1)
    anchor = _ANCHORS[at] == hashes
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    content = np.flatnonzero(~anchor)
    anchors = np.flatnonzero(anchor)
    first = np.searchsorted(content, anchors)
    whole = first + CHAIN <= len(content)
    anchors, first = anchors[whole], first[whole]
    whole = row[content[first + CHAIN - 1]] == row[anchors] if len(anchors) else np.zeros(0, bool)
    anchors, first = anchors[whole], first[whole]
    made = hashes[anchors]
    for j in range(CHAIN):
        made = textkit.mix(made) + hashes[content[first + j]] * U(0xD6E8FEB86659FD93)
    made = (textkit.mix(made) >> U(32)).astype(np.uint32)
    ends = np.searchsorted(row[anchors], np.arange(len(column) + 1))
    out = []
    for i in range(len(column)):
        found = np.unique(made[ends[i] : ends[i + 1]])
        if not len(found) and offsets[i] < offsets[i + 1]:
            found = np.array([int(textkit.hash_sequence(hashes[offsets[i] : offsets[i + 1]])) >> 32], dtype=np.uint32)
        elif not len(found) and (text := column[i].as_py()):
            found = np.array([int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")], dtype=np.uint32)
        out.append(found)
    return out


def packed(fingerprint: np.ndarray) -> str:
    """A fingerprint as text: its signatures in order, big-endian, in base64."""
    return base64.b64encode(fingerprint.astype(">u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 without a comparison if their lengths rule out `least`. Two empty ones are alike."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    if short < least * long or not short:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (short + long - both)


def _cuts(rows: DataFrame, parts: int) -> list[float]:
    """At most parts - 1 ids that split rows evenly, near enough."""
    found = rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted(set(found or []))


def in_order(docs: DataFrame, classes: DataFrame | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, guard, id, class, text): docs dealt by ranges of the id and ordered in them; each range ends with a guard row, the first row of the next.

    The last range's guard is the first row of all. Ids ascend, nulls first, equal ids by
    text. A row of classes (id, class) comes before the docs of its id; docs have a null class.
    There are as many ranges as it takes for ROWS_PER_RANGE docs in each, and every range is a partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    cuts = _cuts(rows.select("id"), parts)
    below = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("id").cast("double"))) if cuts else F.lit(0)
    dealt = lambda df: df.withColumn("part", F.coalesce(F.when(F.col("id").isNotNull(), below), F.lit(0)))
    rows = dealt(rows)
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first")).orderBy("part").collect()
    used = [r["part"] for r in firsts]
    guards = [(r["first"]["id"], used[i - 1]) for i, r in enumerate(firsts)]
    where = F.broadcast(spark.createDataFrame(guards, "first_id long, before int"))
    first = rows.join(where, F.col("id").eqNullSafe(F.col("first_id"))).groupBy("before", "id").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("long")
    rows = rows.select("part", F.lit(0).alias("guard"), "id", none.alias("class"), "text").union(first.select("before", F.lit(1), "id", none, "text"))
    if classes is not None:
        rows = rows.union(dealt(classes).select("part", F.lit(0), "id", "class", F.lit("")))
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "guard", F.col("id").asc_nulls_first(), F.col("class").asc_nulls_last(), "text")


def _edited(batches) -> Iterator[pa.RecordBatch]:
    held = None  # part, id, class, text and fingerprint of the row whose next one comes
    named = (None, None)  # the id that the last class row was for, and its class
    for batch in batches:
        for start, texts in textkit.slices(batch.column(4), 1 << 20):
            part, guard, ids, classes = (batch.column(k).slice(start, len(texts)).to_pylist() for k in range(4))
            own = []
            for i, c in zip(ids, classes, strict=True):
                named = (i, c) if c is not None else named
                own.append(named[1] if named[0] == i else None)
            docs = [k for k, c in enumerate(classes) if c is None]
            pairs, texts = [], texts.take(pa.array(docs, pa.int64()))
            for k, text, found in zip(docs, texts.to_pylist(), fingerprints(texts), strict=True):
                row = (part[k], ids[k], own[k], text, found)
                if held and held[0] == row[0]:
                    pairs.append((held, row))
                held = None if guard[k] else row
            halves = [len(a[3]) // 2 for a, _ in pairs]
            edits = [a[3][: len(a[3]) - h] + b[3][:h] for (a, b), h in zip(pairs, halves, strict=True)]
            after = fingerprints(pa.array(edits, pa.large_string())) if edits else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                    pa.array([packed(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([packed(e) for e in after], pa.string()),
                    pa.array([likeness(a[4], e) for (a, _), e in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    pa.array([a[1] if a[2] is None else a[2] for a, _ in pairs], pa.int64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"],
            )


def edit_test(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: bool = False, percent: int = 80) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, for every row of docs; with classes also component_id, as near_duplicates() has it.

    The edited text has the last floor(n / 2) code points replaced by the first as many
    (or all) of the next document's, in order of doc_id; the last document is followed by
    the first, and so a single one by itself. Null texts are empty. Null ids come first and
    equal ids are ordered by text. Texts are used whole; other columns are ignored.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
    found = near_classes(docs, percent, doc_id, text).select("id", F.col("component_id").alias("class")) if classes else None
    made = in_order(docs, found, doc_id, text).mapInArrow(_edited, schema)
    return made if classes else made.drop("component_id")


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, items): the signatures of every row of docs, as 32-bit numbers; null and empty texts have none."""

    def run(batches):
        for batch in batches:
            for start, texts in textkit.slices(batch.column(1), 1 << 20):
                found = fingerprints(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32))
                values = pa.array(np.concatenate(found).view(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(offsets, values)], ["id", "items"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, items array<int>")


class SpotPairing(ShinglePairing):
    """Links of signature sets (id, items); lengths are the only cheap bound."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.nodes = sets.select("id", F.size("items").cast("long").alias("n_shingles"))

    def meet(self, ids: DataFrame) -> None:
        pass

    def near(self, pairs: DataFrame) -> DataFrame:
        rows = self._sided(pairs, self.nodes, ["n_shingles"])
        return rows.where(F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * self.percent).select("a", "b")


def length_part(n: Column, percent: int) -> Column:
    """Partition number of a set length: sets that are alike enough are in equal or adjacent partitions."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")


def near_classes(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id), a kept table: the class of every id that has a fingerprint; see near_duplicates().

    Equal sets are first reduced to one. Sets are partitioned by length; a set is indexed
    in its partition and the next one by its rarest signatures, so many that sets alike
    enough share one of them.
    """
    made = keep(fingerprint(docs, doc_id, text).where(F.col("id").isNotNull() & (F.size("items") > 0)), "prints")
    groups = keep(made.groupBy("items").agg(F.min("id").alias("first_id")), "groups")
    members = keep(made.join(groups, "items").select("id", "first_id").distinct(), "members")
    drop(made)
    sets = groups.select(F.col("first_id").alias("id"), "items")
    each = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    rare = each.join(each.groupBy("item").agg(F.count(F.lit(1)).alias("df")), "item").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("rare"))
    prefix = F.slice("rare", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100).cast("int") + 1)
    part = length_part(F.col("n"), percent)
    keyed = rare.select("id", F.explode(F.array(part, part + 1)).alias("part"), prefix.alias("prefix")).select("id", "part", F.explode("prefix").alias("p"))
    keyed = keep(keyed.select(F.xxhash64("part", "p.item").alias("key"), "id"), "keyed")
    shared = members.groupBy("id").agg(F.min("first_id").alias("a"), F.max("first_id").alias("hi")).where("a < hi").select("id", "a")
    twins = members.join(shared, "id").select("a", F.col("first_id").alias("b"))
    parts = link(keyed, SpotPairing(sets, percent), twins).select(F.col("id").alias("first_id"), "component")
    placed = members.join(parts, "first_id", "left").groupBy("id").agg(F.min(F.coalesce("component", "first_id")).alias("component_id"))
    placed = keep(placed, "placed")
    for table in (groups, members, keyed):
        drop(table)
    return placed


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of docs: classes of documents linked by Jaccard similarity of fingerprints.

    component_id is the smallest doc_id reachable. Documents of one id count as one;
    empty fingerprints and null ids are linked with nothing (null ids get null).
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    return ids.join(near_classes(docs, percent, doc_id, text), "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("component_id", "id").alias("component_id"))
