"""Connected components and links of large groups, without ever listing a group's pairs.

Items come as (key, id) rows: items under one key are candidates for each other.
All links between items under a common key count, but only these pairs are formed:

1. Under each key every item is paired with the smallest and the largest id there.
   Confirmed pairs are joined to components.
2. Keys that still hold several components are left, and in them the items that may
   have links to other components at all. The best linked item of a key's largest
   component is its pivot. Every item is described by what it adds to its pivot and what
   it misses of it, which is little where items are much alike, and which tells whether
   the two are linked.
3. Under each pivot that still has several components, the items outside the largest one
   are compared with those of other components by these differences. Two items that are
   linked, but not both to the pivot, differ from it in some common elements, in so many
   at least as the sum of what each needs says. So of each item's differences, rarest first, only
   a prefix is indexed, and two items meet if their prefixes have an element in common. The
   differences give the exact similarity, so only true links come out.

A pair that is never formed has both its items in one component already, so the
components are those of all links.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.links import connected
from cuesheet.scratch import drop, keep

BANDS = 8  # of items under one pivot
MAPS = 8  # bit maps of 64 bits of an item's differences


class Pairing(Protocol):
    """What link() asks of a similarity. Pairs (a, b) are distinct, with a < b."""

    def meet(self, ids: DataFrame) -> None:
        """Told once which ids share a key with others."""

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs without those that cheap bounds rule out."""

    def narrow(self, members: DataFrame) -> DataFrame:
        """(id) of those members (id, part) that may have a link to a member of another part."""

    def deltas(self, rows: DataFrame) -> DataFrame:
        """rows (pivot, id) with size, pivot_size, added and missing: how the set of id differs from the pivot's."""

    def linked_to_pivot(self) -> Column:
        """Whether the id of a row of deltas() is linked to its pivot."""

    def need(self) -> Column:
        """A number for each row of deltas(): ids of two rows of one pivot are linked if and only if UNIT times the number of their common differences is the sum of their numbers or more."""

    unit: int

    def linked(self, one: str, two: str) -> Column:
        """Whether the ids of two rows of deltas() with one pivot, in columns with these prefixes, are linked."""

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links."""


def _ordered(pairs: DataFrame, one: str, two: str) -> DataFrame:
    return pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """rows (key, id, part, ...) of the keys with several parts, with the key's largest part as main."""
    sizes = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("main")).where("parts > 1")
    return rows.join(several.select("key", F.col("main.part").alias("main")), "key")


def link(keyed: DataFrame, pairing: Pairing, known: DataFrame) -> DataFrame:
    """(id, component) of all ids of keyed (key, id) that have links; the others have none. known (a, b) are links in any case."""
    ends = keep(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "ends")
    held = keep(keyed.join(ends, "key").select("key", "id", "lo", "hi"), "held")
    pairing.meet(held.select("id").distinct())
    first = held.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p"))
    stars = keep(pairing.near(first.select("p.a", "p.b").where("a < b").distinct()), "stars")
    links = keep(pairing.confirm(stars), "links")
    parts = keep(connected(links), "parts")

    rows = held.select("key", "id").join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    wide = keep(_open(rows), "several")
    able = keep(pairing.narrow(wide.select("id", "part").distinct()), "able")
    rows = keep(_open(wide.select("key", "id", "part").join(able, "id")), "several")
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hubs = parts.join(degrees, "id").groupBy(F.col("component").alias("main")).agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"))
    under = rows.select("main", "id").distinct().join(hubs, "main", "left").select(F.coalesce("hub", "main").alias("pivot"), "id")
    under = under.union(under.select("pivot", F.col("pivot").alias("id"))).distinct()
    deltas = keep(pairing.deltas(under), "deltas")
    more = keep(_ordered(deltas.where((F.col("id") != F.col("pivot")) & pairing.linked_to_pivot()), "id", "pivot"), "links")
    again = _joined(parts, more)
    placed = deltas.join(again, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component").withColumnRenamed("pivot", "key")
    spread = keep(_open(placed), "spread")
    last = keep(_met(spread, pairing), "links")
    given = keep(known.select("a", "b"), "links")
    result = _joined(again, last.union(given))
    for table in (ends, held, stars, links, parts, wide, able, rows, deltas, more, again, spread, last, given):
        if table is not result:
            drop(table)
    return result


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """parts (id, component) of some links after more links (a, b): parts itself without any, else made from its stars, which say what its links do."""
    if more.isEmpty():
        return parts
    stars = parts.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return keep(connected(stars.union(more)), "parts")


def _meetings(spread: DataFrame, pairing: Pairing) -> DataFrame:
    """(key, x_id, y_id), repeated, of items under a key that may be linked: rows of deltas() (key, id, part, main, ...) of an item outside the key's main part with one of another part.

    A pair that isn't linked through its pivot needs at least one common difference. With
    the differences in one order, the first |D| - n + 1 of two items that have n in common
    share one; n is bounded from below by the least number that a partner can have. Items are
    dealt to BANDS of that number, and those outside the main part have a prefix for each band of partners; an element of the others says for which bands it is in theirs: one item of few
    differences doesn't lengthen the prefixes of all. Orders by rarity make few items meet, and of these only those pass that can have as many differences
    in common by their bit maps: a bit that one item has and the other one hasn't is a difference of its own.
    """
    rows = spread.select("key", "id", "part", "main", pairing.need().alias("need"), F.concat("added", "missing").alias("changed")).where(F.size("changed") > 0)
    bits = [F.expr(f"aggregate(changed, 0L, (acc, e) -> acc | if((shiftright(cast(e as bigint), 6) & {MAPS - 1}) = {k}, shiftleft(1L, cast(e & 63 as int)), 0L))").alias(f"m{k}") for k in range(MAPS)]
    rows = rows.select("*", F.size("changed").alias("n_changed"), F.struct(*bits).alias("bits"))
    sides = rows.groupBy("key").agg(F.min("need").alias("least"), F.min(F.when(F.col("part") != F.col("main"), F.col("need"))).alias("least_outside"), F.percentile_approx("need", [k / BANDS for k in range(1, BANDS)]).alias("cuts"))
    sides = sides.where("least_outside is not null").select("key", "least_outside", F.array_sort(F.array_distinct(F.concat(F.array("least"), "cuts"))).alias("cuts"))
    each = rows.join(sides, "key").withColumn("band", F.size(F.filter("cuts", lambda c: c <= F.col("need")))).select("*", F.explode("changed").alias("element")).drop("changed")
    counted = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "element")))
    ordered = counted.groupBy("key", "id").agg(*[F.first(c).alias(c) for c in ("part", "main", "need", "least_outside", "cuts", "band", "n_changed", "bits")], F.sort_array(F.collect_list(F.struct("n", "element"))).alias("changed"))

    kept = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("id", "part", "need", "n_changed", "bits", "band")]
    common = lambda cut: F.greatest(F.ceil((F.col("need") + cut) / pairing.unit), F.lit(1))
    first = "slice(changed, 1, greatest(0, least(size(changed), cast(size(changed) - common + 1 as int))))"

    def prefixes() -> DataFrame:
        """Of items outside the main part, a row for each band of partners and element of the prefix that is asked for them; what no other item has can't be common."""
        towards = ordered.where("part <> main").select("*", F.posexplode("cuts").alias("at", "cut")).withColumn("common", common(F.col("cut")))
        return towards.select("key", *kept("x"), (F.col("at") + 1).alias("y_band"), F.explode(F.expr(f"transform(filter({first}, x -> x.n > 1), x -> x.element)")).alias("element"))

    def reaching() -> DataFrame:
        """Of all items, a row for each element of the longest prefix, with the last band of partners whose prefix still has it."""
        longest = ordered.withColumn("asked", F.transform("cuts", lambda c: common(F.greatest(c, F.col("least_outside"))))).withColumn("common", F.element_at("asked", 1))
        each = longest.select("key", *kept("y"), "asked", F.explode(F.expr(f"filter(transform({first}, (x, p) -> struct(x.n as n, x.element as element, size(changed) - p as rest)), x -> x.n > 1)")).alias("e"))
        return each.select(*[c for c in each.columns if c not in ("asked", "e")], F.col("e.element").alias("element"), F.size(F.filter("asked", lambda k: k <= F.col("e.rest"))).alias("y_reach"))

    def possible(one: str, other: str) -> Column:
        alone = reduce(add, [F.bit_count(F.col(f"{one}_bits.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}_bits.m{k}")))) for k in range(MAPS)])
        return (F.col(f"{one}_n_changed") - alone) * pairing.unit >= F.col("x_need") + F.col("y_need")

    met = prefixes().join(reaching(), ["key", "y_band", "element"]).where("x_band <= y_reach").where((F.col("x_part") != F.col("y_part")) & possible("x", "y") & possible("y", "x"))
    return met.select("key", "x_id", "y_id")


def _met(spread: DataFrame, pairing: Pairing) -> DataFrame:
    """The links (a, b) among _meetings()."""
    pairs = _meetings(spread, pairing).distinct()
    side = lambda name: spread.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "size", "pivot_size", "added", "missing")])
    both = pairs.join(side("x"), ["key", "x_id"]).join(side("y"), ["key", "y_id"])
    return _ordered(both.where(pairing.linked("x_", "y_")), "x_id", "y_id")
