"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of words with smallest period q that holds TIMES periods and LEAST
words at least, and that no neighbouring word extends. Words q apart are equal throughout
it, so among its first words, all but the last q, are two multiples of q in a row. For
each period p the words at jp and (j + 1)p are compared, for all j at once; places where
this holds twice in a row are compared word by word in chunks, and what survives is
extended to both sides in growing chunks. Grid points inside a stretch just found, or
inside a run whose period divides p, are skipped. The probes of all periods together are
n ln n comparisons for n words.

Words are numbered exactly, so equal numbers are equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.text import let

from . import textkit

LEAST = 24
TIMES = 3
CHUNK = 8
BLOCK = 1 << 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def _same(x: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """Those of the places from which p words in a row equal the words p further on."""
    done, chunk = 0, CHUNK
    while done < p and len(at):
        step = min(chunk, p - done)
        kept = []
        for part in range(0, len(at), max(1, BLOCK // step)):
            rows = at[part : part + max(1, BLOCK // step)]
            where = rows[:, None] + np.arange(done, done + step)
            kept.append(rows[(x[where] == x[where + p]).all(axis=1)])
        at, done, chunk = np.concatenate(kept), done + step, chunk * 4
    return at


def _stretch(x: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """[low, high) of the places around `at` whose words equal those p further on."""
    low, high, chunk = at, at, CHUNK
    while high + p < len(x):
        stop = min(high + chunk, len(x) - p)
        other = np.flatnonzero(x[high:stop] != x[high + p : stop + p])
        if len(other):
            high += int(other[0])
            break
        high, chunk = stop, min(2 * chunk, BLOCK)
    chunk = CHUNK
    while low:
        stop = max(0, low - chunk)
        other = np.flatnonzero(x[stop:low] != x[stop + p : low + p])
        if len(other):
            low = stop + int(other[-1]) + 1
            break
        low, chunk = stop, min(2 * chunk, BLOCK)
    return low, high


def _outside(at: np.ndarray, p: int, found: np.ndarray) -> np.ndarray:
    """Those of the places that aren't, with the word p further on, inside a found run (start, length, period) whose period divides p."""
    own = found[(p % found[:, 2] == 0) & (found[:, 1] > p)]
    if not len(own):
        return at
    own = own[np.argsort(own[:, 0], kind="stable")]
    reach = np.maximum.accumulate(own[:, 0] + own[:, 1] - p)
    last = np.searchsorted(own[:, 0], at, side="right") - 1
    return at[(last < 0) | (reach[np.maximum(last, 0)] <= at)]


def runs_of(x: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs in x, in order of periods.

    x: texts of falling numbers of words (sizes) one after another, each followed by a
    number that occurs once, so that no run crosses texts.
    """
    found: list[tuple[int, int, int]] = []
    known, table = set(), np.zeros((0, 3), np.int64)
    ends = np.cumsum(sizes + 1)
    for p in range(1, (int(sizes[0]) if len(sizes) else 0) // times + 1):
        n_texts = int(np.searchsorted(-sizes, -max(times * p, least), side="right"))  # texts that are long enough come first
        if not n_texts:
            break
        own = x[: ends[n_texts - 1]]
        grid = own[::p]
        equal = grid[1:] == grid[:-1]
        at = np.flatnonzero(equal[1:] & equal[:-1]) * p
        if len(at) and len(table):
            at = _outside(at, p, table)
        at = _same(own, at, p) if len(at) else at
        passed, before = 0, len(found)
        for place in at.tolist():
            if place < passed:
                continue
            low, passed = _stretch(own, place, p)
            length = passed - low + p
            if length >= max(least, times * p) and (low, length) not in known:
                known.add((low, length))
                found.append((low, length, p))
        if len(found) > before:
            table = np.array(found, dtype=np.int64)
    return table


def collapsed(texts: list[str], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(rows (start, length, period) by text, start, period; n + 1 offsets; texts without what repeats in runs; numbers of words)."""
    words = [t.encode().split() for t in texts]  # bytes are split at exactly the six ASCII blanks
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(least, times)]
    number: dict[bytes, int] = {}
    parts = []
    for k, i in enumerate(order.tolist()):
        parts += [np.fromiter((number.setdefault(w, len(number)) for w in words[i]), np.int64, count=len(words[i])), np.array([-1 - k])]
    x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    found = runs_of(x, sizes[order], least, times)
    begins = np.concatenate(([0], np.cumsum(sizes[order] + 1)))
    place = np.searchsorted(begins, found[:, 0], side="right") - 1
    text = order[place] if len(found) else np.zeros(0, np.int64)
    found[:, 0] -= begins[place]
    by = np.lexsort((found[:, 2], found[:, 0], text))
    found, text = found[by], text[by]
    offsets = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i, w in enumerate(words):
        if offsets[i] < offsets[i + 1]:
            keep = np.ones(len(w), dtype=bool)
            for start, length, period in found[offsets[i] : offsets[i + 1]].tolist():
                keep[start + period : start + length] = False
            w = [w[k] for k in np.flatnonzero(keep).tolist()]
        out.append(b" ".join(w).decode())
    return found, offsets, out, sizes


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs.

    Words are what ASCII blanks (0x20, 0x09-0x0D) separate. runs: all runs by start, then
    period, in words from 0. collapsed: the words, each joined to the next by one space,
    without those that a run holds after its first period. Null, empty and blank texts
    have no words, no runs and an empty collapsed text. Texts are read whole, however
    long; repeated rows and null ids give a row each; other columns are ignored,
    whatever their names. Rows don't move.
    """

    def run(batches):
        for batch in batches:
            for start, part in textkit.slices(batch.column(1), 1 << 20):
                found, offsets, out, sizes = collapsed(part.fill_null("").to_pylist(), least, times)
                rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(sizes), lists, pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(textkit.tidy(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start, then period. Null without runs."""
    left, right = (lambda a, b: a["length"] * b["period"]), (lambda a, b: b["length"] * a["period"])
    better = lambda a, b: (left(a, b) > right(a, b)) | ((left(a, b) == right(a, b)) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.get(F.array_sort(runs, lambda a, b: F.when(better(a, b), -1).when(better(b, a), 1).otherwise(0)), F.lit(0))


def with_periodic_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a periodic end in every tenth text, by h = crc32(doc_id as text): a test of collapse().

    With g = h // 10 and n > 0 words, words from a = g % n on repeat the p = 1 + (n - a) // (3 + g % 8)
    words there. Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda ap: F.transform(words, lambda w, i: F.when(i < ap["a"], w).otherwise(F.get(words, ap["a"] + (i - ap["a"]) % ap["p"])))
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), place), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda w: w != "")
    return docs.withColumn(text, F.when(h % 10 == 0, let(words, tail)).otherwise(F.col(text)))
