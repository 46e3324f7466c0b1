"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Texts are split into runs of letters and digits and runs of symbols. Features are
1- and 2-grams of these runs' hashes; a run that repeats the one before it gives one
common 2-gram. A feature's value is its share of the text, square-rooted and scaled to
unit length, so long texts count like short ones. A score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

BITS = 18
TRAIN_ROWS = 16_000
SLICE = 1 << 19  # bytes of text that features are made of at a time
U = np.uint64
#: Kinds of bytes: 0 white space, 1 letters, digits and all of non-ASCII, 2 other signs.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_REPEAT, _CAPITALS = textkit.mix(np.array([11, 12], dtype=U))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, feature numbers as int32, values) of all rows; an empty row has no features."""
    data, offsets = textkit.text_bytes(column)
    starts, ends = textkit.runs(data, offsets, _KIND[data])
    hashes = textkit.hash_runs(data, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    uppers = np.concatenate(([0], np.cumsum(_UPPER[data])))
    capital = (ends - starts > 2) & (uppers[ends] - uppers[starts] == ends - starts)
    next_in_row = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pairs = textkit.mix(hashes[:-1] * U(0xD6E8FEB86659FD93) + hashes[1:])
    repeat = hashes[:-1] == hashes[1:]
    pairs = np.where(repeat, _REPEAT, pairs)[next_in_row]
    all_rows = np.concatenate((row, row[:-1][next_in_row], row[capital]))
    all_hashes = np.concatenate((hashes, pairs, np.full(int(capital.sum()), _CAPITALS)))
    keys = (all_rows.astype(U) << U(bits)) | (all_hashes >> U(64 - bits))
    unique, counts = np.unique(keys, return_counts=True)
    rows = (unique >> U(bits)).astype(np.int64)
    values = np.sqrt(counts.astype(np.float64))
    norms = np.sqrt(np.bincount(rows, weights=counts, minlength=len(column)))
    return np.searchsorted(rows, np.arange(len(column) + 1)), (unique & U((1 << bits) - 1)).astype(np.int32), values / norms[rows]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[np.ndarray], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, updates: int = 40_000) -> np.ndarray:
    """Weights after FTRL-proximal updates, one row after another; the last weight is the bias.

    made are features() of the rows in pieces; values may be single precision. All rows are gone through as often as it takes for so many updates, twice at least
    and forty times at most.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rows = sum(map(len, labels))
    for _ in range(min(40, max(2, -(-updates // max(1, rows))))):
        for (offsets, at, values), y in zip(made, labels, strict=True):
            for i in range(len(y)):
                f = np.append(at[offsets[i] : offsets[i + 1]], 1 << bits)
                x = np.append(values[offsets[i] : offsets[i + 1]], 1.0)
                zf, nf = z[f], n[f]
                w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
                g = (_sigmoid(w @ x) - y[i]) * x
                grown = nf + g * g
                z[f] = zf + g - (np.sqrt(grown) - np.sqrt(nf)) / alpha * w
                n[f] = grown
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def train_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label): at most bound labelled rows that learn holds for, those with the smallest hashes of doc_id.

    Labels other than 0 and 1 and null ids don't count; of a repeated id the largest label does.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.where(learn).groupBy("id").agg(F.max("label").alias("label"))
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    chosen = marked.join(known.select("id").distinct(), "id", "left_semi").orderBy(F.md5(F.col("id").cast("string")), "id").limit(bound)
    return known.join(F.broadcast(chosen), "id").orderBy(F.md5(F.col("id").cast("string")), "id", "text").limit(bound).select("text", "label")


def fit(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """Weights learned from rows (text, label), in their order, in one task: rows are a bounded sample.

    Without rows all weights are 0, and every score is 0.5.
    """

    def run(batches):
        made, labels = [], []
        for batch in batches:
            for start, part in textkit.slices(batch.column(0), SLICE):
                offsets, at, values = features(part, bits)
                made.append((offsets, at, values.astype(np.float32)))
                labels.append(batch.column(1).slice(start, len(part)).to_numpy().copy())
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(made, labels, bits).tobytes()], pa.binary())], ["weights"])

    found = rows.coalesce(1).mapInArrow(textkit.tidy(run), "weights binary").collect()
    return np.frombuffer(found[0][0], dtype=np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def carried(docs: DataFrame, carry: Sequence[str]) -> str:
    """Columns of docs as the end of a schema."""
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score) of every row: the estimated probability of label 1. Null and empty texts get the bias's score.

    The columns named in carry follow, so that a row's score stays with the row whatever its doc_id.
    A row's sum is made of its own features in order, so equal texts get equal scores.

    The weights are broadcast; their size is fixed by bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            for start, part in textkit.slices(batch.column(1), SLICE):
                offsets, at, values = features(part, bits)
                row = np.repeat(np.arange(len(part)), np.diff(offsets))
                sums = np.bincount(row, weights=w[at] * values, minlength=len(part))
                rest = [batch.column(1 if c == text else 2 + others.index(c)).slice(start, len(part)) for c in carry]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(_sigmoid(sums + float(w[-1]))), *rest], ["doc_id", "score", *carry])

    others = [c for c in carry if c != text]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *others)
    return rows.mapInArrow(textkit.tidy(run), f"doc_id long, score double{carried(docs, carry)}")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, train_limit: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, and its columns named in carry.

    Learns from labelled rows whose crc32(doc_id) modulo folds is not held, train_limit
    of them at most; scores all rows. Null and empty texts have a score too; a null
    doc_id is not held out. Repeated rows give a row each. Other columns are ignored.
    """
    weights = fit(train_rows(docs, labels, label, bucket(F.col("id"), folds) != held, train_limit, doc_id, text))
    scored = score(docs, weights, doc_id, text, carry=carry)
    held_out = F.coalesce(bucket(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
