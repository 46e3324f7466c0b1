"""Toxicity by class-conditional Kneser-Ney models.

Two models of the labelled texts, one of toxic and one of ordinary ones, give every word
a likelihood. A class's model has first terms from its own Kneser-Ney counts, and
leaves the rest to backoff counts that both classes share:

    P(w)      = first(w) + left * shared(w)
    first(w)  = max(0, n(w) - rate * e(w) - NOISE * sqrt((1 - share) * e(w))) / n
    e(w)      = share * (n(w) of both classes)
    share     = n / (n of both classes)
    rate      = RATE / (1 + (RATE - 1) * share)
    shared(w) = (n(w) of both + PRIOR) / (n of both + PRIOR * (words of both + 1))

n(w) is the class's continuation count of w, after how many different words it stands in
the class's texts, so that copies of a text count once; n is their sum, and left what the
first terms leave of 1. The discount grows with e(w), what the shared counts lead one to
expect: a word gets a first term if the class says it more than RATE times as often as the
other one does (n(w) > rate * e(w) says that of the shared counts), and by NOISE standard
deviations more. All else, rare expressions above all, gets its likelihood from
the shared counts in both models, so that neither the languages that a class happens to
have nor the noise of small counts adds up over long texts. Both classes are treated alike.

Above the words stand pairs, a word w after a word v (none at the start of a text), which
back off to them:

    P(w | v) = first(v, w) + left(v) * P(w)
    first(v, w) = max(0, n(v, w) - max(1, rate * e(v, w) + PAIR_NOISE * sqrt((1 - share) * e(v, w)))) / n(v)

n(v, w) is the pair's continuation count, after how many different words it stands in the class's
texts (told apart by 16 bits), n(v) their sum; e, share and rate are as above,
of the pairs that begin with v in both classes. left(v) is what the first terms of v leave of 1,
and 1 for a v without any.

A text's score is a rising curve of one number, the mean over all of its words of
log P(w | v, toxic) - log P(w | v, ordinary): the difference of the length-normalised
log-likelihoods. It is counted from the constant that words without first terms have,
which differs between models. The logistic curve is fitted to labelled texts scored by
models that leave them out (cross-fitting by FOLDS).

Counts are Spark tables that grow with the corpus. The words and pairs with first terms are
broadcast while they are at most BROADCAST_ENTRIES, beyond that joined with the texts'
words. Both ways sum the same integers, so scores are equal to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.scratch import drop, keep

from . import textkit
from .quality import _sigmoid, bucket, carried

U = np.uint64
FOLDS = 3
WORD_BITS = 40
RATE = 2.25
NOISE = 4
PAIR_NOISE = 4
PRIOR = 0.5
UNIT = 1 << 24  # of log ratios as integers
CALIBRATION_ROWS = 20_000
BROADCAST_LABELS = 2_000_000
BROADCAST_ENTRIES = 2_000_000
MODELS = range(1 + FOLDS)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, v, offsets): 40-bit hashes of all words and of the words before them (0: none), and row offsets."""
    w, offsets = textkit.letters(column)
    w >>= U(64 - WORD_BITS)
    v = np.zeros(len(w), U)
    v[1:] = w[:-1]
    v[offsets[:-1][np.diff(offsets) > 0]] = 0
    return w, v, offsets


def _triples(batches):
    """The different (word, word before, hash of the word before that) of each piece, as 40, 40 and 16 bits, with a bit for each fold and class that has them: two numbers, since small columns cost disk in a shuffle."""
    for batch in batches:
        cells = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
        for start, part in textkit.slices(batch.column(0), 1 << 20):
            w, v, offsets = grams(part)
            u = np.zeros(len(v), U)
            u[1:] = v[:-1]
            u[offsets[:-1][np.diff(offsets) > 0]] = 0
            cell = np.repeat(cells[start : start + len(part)], np.diff(offsets))
            a, b, bits = (w << U(24)) | (v >> U(16)), ((v & U(0xFFFF)) << U(16) | (u & U(0xFFFF))).astype(np.uint32), (1 << cell).astype(np.int8)
            order = np.lexsort((b, a))
            a, b, bits = a[order], b[order], bits[order]
            first = np.ones(len(a), dtype=bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(first)
            bits = np.bitwise_or.reduceat(bits, at) if len(at) else bits
            yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(b[at].astype(np.int64) << 8 | bits)], ["a", "rest"])


def _mask(model: int, label: int) -> int:
    """The cells of a class that a model counts: model 0 counts all, model 1 + f all but those of fold f."""
    return sum(1 << (2 * fold + label) for fold in range(FOLDS) if fold != model - 1)


def _discounted(n: Column, both: Column, share: Column, noise: float, least: float = 0.0) -> Column:
    """What a count keeps above what the shared counts lead one to expect."""
    expected = both * share
    discount = F.lit(RATE) / (1 + (RATE - 1) * share) * expected + noise * F.sqrt((1 - share) * expected)
    return F.greatest(n - F.greatest(discount, F.lit(least)), F.lit(0.0))


@dataclass
class Counts:
    """words: a kept table (w, n<model>_<class>) of continuation counts; totals: their sums, and the numbers of words, types<model>.

    pairs: a kept table (v, w, first<model>_<class>, n<model>_<class>) of the pairs with a first term in some model: the term before
    it is divided, and the number of all pairs of v.
    """

    words: DataFrame
    totals: dict[str, int]
    pairs: DataFrame

    def drop(self) -> None:
        drop(self.words)
        drop(self.pairs)


def count(rows: DataFrame) -> Counts:
    """Counts of all rows (text, label, fold) for all models."""
    has = lambda condition: F.sum(condition.cast("int"))
    of_models = lambda name, value: [value(m, c).alias(f"{name}{m}_{c}") for m in MODELS for c in (0, 1)]
    each = rows.select("text", (2 * F.col("fold") + F.col("label")).cast("int").alias("cell")).mapInArrow(textkit.tidy(_triples), "a long, rest long")
    each = each.repartition("a")  # moved once, for both counts
    triples = each.groupBy("a", F.shiftright("rest", 8).alias("bu")).agg(F.bit_or(F.col("rest").bitwiseAND(0xFF)).alias("cells"))
    packed = triples.groupBy("a", F.shiftright("bu", 16).cast("int").alias("b")).agg(*of_models("p", lambda m, c: has(F.col("cells").bitwiseAND(F.lit(_mask(m, c))) != 0)))
    packed = keep(packed, "pairs")
    w = F.shiftrightunsigned("a", 24).alias("w")
    words = keep(packed.groupBy(w).agg(*of_models("n", lambda m, c: has(F.col(f"p{m}_{c}") > 0))), "words")
    sums = [F.sum(f"n{m}_{c}").alias(f"n{m}_{c}") for m in MODELS for c in (0, 1)]
    totals = words.agg(*sums, *[has(F.col(f"n{m}_0") + F.col(f"n{m}_1") > 0).alias(f"types{m}") for m in MODELS]).first()

    v = F.shiftleft(F.col("a").bitwiseAND((1 << 24) - 1), 16).bitwiseOR(F.col("b").cast("long").bitwiseAND(0xFFFF)).alias("v")
    after = packed.groupBy(v).agg(*of_models("n", lambda m, c: F.sum(f"p{m}_{c}")))
    said = packed.where(F.greatest("p0_0", "p0_1") > 1).select(v, w, *[f"p{m}_{c}" for m in MODELS for c in (0, 1)]).join(after, "v")  # of what is said once, the discount leaves nothing
    first = []
    for m in MODELS:
        all_of_v, both = F.col(f"n{m}_0") + F.col(f"n{m}_1"), F.col(f"p{m}_0") + F.col(f"p{m}_1")
        for c in (0, 1):
            share = F.col(f"n{m}_{c}") / F.greatest(all_of_v, F.lit(1))
            first.append(_discounted(F.col(f"p{m}_{c}"), both, share, PAIR_NOISE, 1.0).alias(f"first{m}_{c}"))
    said = said.select("v", "w", *first, *[f"n{m}_{c}" for m in MODELS for c in (0, 1)])
    said = said.where(F.greatest(*[f"first{m}_{c}" for m in MODELS for c in (0, 1)]) > 0)
    pairs = keep(said.hint("rebalance"), "pair_terms")
    drop(packed)
    return Counts(words, {k: v or 0 for k, v in totals.asDict().items()}, pairs)


@dataclass
class Model:
    """words: a kept table (w, gain) of words with first terms; gain: their log ratio above that of other words, in whole UNITs. rare: the log ratio of other words.

    pairs: a kept table (v, w, gain) of pairs with first terms; contexts: one (v, back) of the words v that begin such pairs, and what any other word after v has above its own gain.
    """

    words: DataFrame
    rare: float
    pairs: DataFrame
    contexts: DataFrame

    def entries(self) -> int:
        return sum(t.count() for t in (self.words, self.pairs, self.contexts))

    def drop(self) -> None:
        for table in (self.words, self.pairs, self.contexts):
            drop(table)


def model_of(counts: Counts, m: int) -> Model:
    """The model number m of counts."""
    n = [max(1, counts.totals[f"n{m}_{c}"]) for c in (0, 1)]
    both = F.col(f"n{m}_0") + F.col(f"n{m}_1")
    first = [_discounted(F.col(f"n{m}_{c}"), both, F.lit(n[c] / sum(n)), NOISE) for c in (0, 1)]
    shared = (both + F.lit(float(PRIOR))) / F.lit(float(sum(n) + PRIOR * (counts.totals[f"types{m}"] + 1)))
    every = counts.words.select("w", *[first[c].alias(f"first{c}") for c in (0, 1)], shared.alias("shared"))
    found = every.where("first0 > 0 or first1 > 0")
    given = found.agg(*[F.sum(F.round(F.col(f"first{c}") * UNIT).cast("long")).alias(f"g{c}") for c in (0, 1)]).first()
    left = [1 - (given[f"g{c}"] or 0) / UNIT / n[c] for c in (0, 1)]  # summed in whole numbers: the same in any order
    rare = math.log(left[1]) - math.log(left[0])
    p = [F.col(f"first{c}") / F.lit(float(n[c])) + F.lit(left[c]) * F.col("shared") for c in (0, 1)]
    words = found.select("w", F.round((F.log(p[1]) - F.log(p[0]) - F.lit(rare)) * UNIT).cast("long").alias("gain"))
    words = keep(words.hint("rebalance"), "model")  # few words: few files

    terms = counts.pairs.select("v", "w", *[F.col(f"first{m}_{c}").alias(f"pair{c}") for c in (0, 1)], *[F.col(f"n{m}_{c}").alias(f"of_v{c}") for c in (0, 1)]).where("pair0 > 0 or pair1 > 0")
    rest = [1 - F.sum(F.round(F.col(f"pair{c}") * UNIT).cast("long")) / UNIT / F.greatest(F.max(f"of_v{c}"), F.lit(1)) for c in (0, 1)]
    rest = terms.groupBy("v").agg(*[rest[c].alias(f"left{c}") for c in (0, 1)])
    contexts = keep(rest.select("v", F.round((F.log("left1") - F.log("left0")) * UNIT).cast("long").alias("back")).hint("rebalance"), "model")
    after = [F.col(f"pair{c}") / F.greatest(f"of_v{c}", F.lit(1)) + F.col(f"left{c}") * p[c] for c in (0, 1)]
    pairs = terms.join(rest, "v").join(every, "w").select("v", "w", F.round((F.log(after[1]) - F.log(after[0]) - F.lit(rare)) * UNIT).cast("long").alias("gain"))
    return Model(words, rare, keep(pairs.hint("rebalance"), "model"), contexts)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted keys, whether they are there) of what is asked."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Scorer:
    """A model in memory; features() of Arrow texts."""

    def __init__(self, model: Model):
        self.words, self.gains = self._sorted(model.words)
        self.contexts, self.backs = self._sorted(model.contexts)
        v, w, gain = (model.pairs.toArrow().column(k).to_numpy() for k in range(3))
        self.seconds = np.unique(w.view(U))
        pairs = _found(self.contexts, v.view(U))[0] * len(self.seconds) + _found(self.seconds, w.view(U))[0]
        order = np.argsort(pairs)
        self.pairs, self.pair_gains = pairs[order], gain[order]

    def _sorted(self, table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = table.toArrow()
        keys = found.column(0).to_numpy().view(U)
        order = np.argsort(keys)
        return keys[order], found.column(1).to_numpy()[order]

    def features(self, column: pa.Array) -> np.ndarray:
        """A row's sum of gains over its number of words."""
        w, v, offsets = grams(column)
        gains = np.zeros(len(w), np.int64)
        at, there = _found(self.words, w)
        gains[there] = self.gains[at[there]]
        context, there = _found(self.contexts, v)
        held = np.flatnonzero(there)
        if len(held):
            context = context[held]
            gains[held] += self.backs[context]
            second, known = _found(self.seconds, w[held])
            held, pair = held[known], context[known] * len(self.seconds) + second[known]
            at, there = _found(self.pairs, pair)
            gains[held[there]] = self.pair_gains[at[there]]
        sums = np.concatenate(([0], np.cumsum(gains)))[offsets]
        return np.diff(sums) / np.maximum(np.diff(offsets), 1).astype(np.float64) / UNIT


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of the rows of docs with label 0 or 1; of a repeated label the largest counts.

    Labels are broadcast only if a count shows at most BROADCAST_LABELS of them.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(marked) if few else marked, "id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 50) -> tuple[float, float]:
    """(slope, constant) of a ridge logistic regression on one feature, by Newton steps. More evidence can't mean less toxicity: a negative slope is 0."""
    order = np.lexsort((y, x))  # sums don't depend on the order of rows
    x, y = x[order], y[order]
    spread = float(x.std()) or 1.0
    own, b, penalty = np.stack([x / spread, np.ones(len(x))], axis=1), np.zeros(2), ridge * np.diag([1.0, 1e-6])
    for _ in range(steps):
        p = _sigmoid(own @ b)
        move = np.linalg.solve((own.T * (p * (1 - p))) @ own + penalty + 1e-9 * np.eye(2), own.T @ (y - p) - penalty @ b)
        b += move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    if b[0] < 0:
        share = (y.sum() + 1e-6) / (len(y) + 2e-6)
        b = np.array([0.0, math.log(share / (1 - share))])
    return float(f"{b[0] / spread:.9g}"), float(f"{b[1]:.9g}")  # last digits depend on how sums are laid out in memory


def _in_memory(rows: DataFrame, scorer: Scorer, carry: Sequence[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            for start, part in textkit.slices(batch.column(2), 1 << 19):
                rest = [batch.column(2 if c == "text" else 3 + others.index(c)).slice(start, len(part)) for c in carry]
                ids = [batch.column(k).slice(start, len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(shared.value.features(part)), *rest], ["id", "label", "ratio", *carry])

    others = [c for c in carry if c != "text"]
    return rows.select("id", "label", "text", *others).mapInArrow(textkit.tidy(run), f"id long, label int, ratio double{carried(rows, carry)}")


def _row_pairs(batches):
    """(row, v, w, n): the different pairs of each row with their numbers; one (row, null, null, 0) for a row without words."""
    for batch in batches:
        for start, part in textkit.slices(batch.column(1), 2 << 20):
            w, v, offsets = grams(part)
            row = np.repeat(np.arange(len(part)), np.diff(offsets))
            order = np.lexsort((w, v, row))
            w, v, row = w[order], v[order], row[order]
            first = np.ones(len(w), dtype=bool)
            first[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            n = np.diff(np.concatenate((at, [len(w)])))
            ids = batch.column(0).slice(start, len(part)).to_numpy()
            blank = np.flatnonzero(np.diff(offsets) == 0)
            pair = [pa.concat_arrays([pa.array(x[at].view(np.int64)), pa.nulls(len(blank), pa.int64())]) for x in (v, w)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[row[at]], ids[blank]))), *pair, pa.array(np.concatenate((n, np.zeros(len(blank), np.int64))))], ["row", "v", "w", "n"])


def _joined(rows: DataFrame, model: Model, carry: Sequence[str]) -> DataFrame:
    """As _in_memory, by joins: a row's pairs go to the tables and their gains come back. Skewed words are split by AQE."""
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    said = rows.select("_row", "text").mapInArrow(_row_pairs, "row long, v long, w long, n long")
    terms = model.pairs.select("v", "w", F.col("gain").alias("pair_gain"))
    said = said.join(model.words, "w", "left").join(model.contexts, "v", "left").join(terms, ["v", "w"], "left")
    gain = F.coalesce("pair_gain", F.coalesce("gain", F.lit(0)) + F.coalesce("back", F.lit(0)))
    found = said.groupBy("row").agg(F.sum("n").alias("n"), F.sum(gain * F.col("n")).alias("gain"))
    made = found.select("row", (F.col("gain") / F.greatest("n", F.lit(1)) / UNIT).alias("ratio"))
    return rows.join(made, rows["_row"] == made["row"]).select("id", "label", "ratio", *carry)


def featured(rows: DataFrame, model: Model, carry: Sequence[str] = (), broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """rows (id, label, text, ...) with ratio, the mean log ratio above the model's rare, instead of the text, and the columns named in carry. Null and empty texts have 0."""
    return _in_memory(rows, Scorer(model), carry) if model.entries() <= broadcast_entries else _joined(rows, model, carry)


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """n rows (id, text, ...) of the smallest hashes of id, or all. Hashes far beyond the n-th of so many rows are left out first, so that few rows meet."""
    key = F.md5(F.col("id").cast("string"))
    total = rows.select("id").count()
    if total > 2 * n:
        rows = rows.where(F.conv(F.substring(key, 1, 13), 16, 10).cast("double") < F.lit((n + 12.0 * math.sqrt(n) + 100) / total * 2**52))
    return rows.orderBy(key, "text").limit(n)


def _hashed_fold(row_id: Column) -> Column:
    return F.crc32(F.concat(F.lit("curve:"), row_id.cast("string"))) % FOLDS


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, calibration_limit: int = CALIBRATION_ROWS, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, and its columns named in carry.

    Learns from labelled rows whose crc32(doc_id) modulo folds is not held: all of them
    are counted, and a sample of at most calibration_limit fits the curve. Null and
    empty texts get the curve's value for no words. Without any labels all scores are
    0.5. A null doc_id is not held out; equal texts get equal scores; repeated rows
    give a row each; other columns are ignored; texts are read whole.
    """
    known = labelled(docs, labels, label, doc_id, text).where(bucket(F.col("id"), folds) != held).withColumn("fold", _hashed_fold(F.col("id")))
    counts = count(known)
    sample = keep(first_by_hash(known, calibration_limit), "sample")
    x, y = [np.zeros(0)], [np.zeros(0)]
    for fold in range(FOLDS):
        model = model_of(counts, 1 + fold)
        found = featured(sample.where(F.col("fold") == fold), model, (), broadcast_entries).toPandas()
        x.append(found["ratio"].to_numpy())
        y.append(found["label"].to_numpy())
        model.drop()
    slope, constant = logistic(np.concatenate(x), np.concatenate(y)) if sum(map(len, y)) else (0.0, 0.0)
    model = model_of(counts, 0)
    counts.drop()
    drop(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.lit(0).alias("label"), F.col(text).alias("text"), *[F.col(c) for c in carry if c != "text"])
    linear = F.lit(slope) * F.col("ratio") + F.lit(constant)
    scored = featured(rows, model, carry, broadcast_entries).select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-linear))).alias("score"), *carry)
    held_out = F.coalesce(bucket(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
