"""Alignment of two tokenizers' tokens by the bytes that they spell.

Each text is encoded by a byte-level BPE (A, after a space) and by a SentencePiece model
(B, which adds the space). Where both spell the text's bytes, cumulative sums of token
lengths give the tokens' ends. Ends that both have cut a text into groups; tokens of
either side whose byte ranges overlap are linked. How often an id pair is linked is counted over
the whole corpus: each task sums its own links first, then a shuffle with a salt and one
without add them up.

The counts go back to the tokens without moving those. Pairs that are linked once need
no entry, and the highest count of each B id is a vector as long as B's vocabulary. The
other pairs are handed out in slices of at most PAIRS of them, as sorted arrays; each slice
is one pass over the stored tokens, and the integer sums of all passes are added. So
memory is bounded, passes grow with the number of different pairs (at most the product
of the vocabularies), and the results are the same whatever the size of a slice.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.scratch import drop, keep

from . import textkit
from .bytepairs import PATTERN, BytePairs
from .pieces import BYTE, SPACE, load, parse

PAIRS = 6_000_000
SALTS = 8
TOKENS = 1 << 17  # of a piece of a batch
SUMMED = 1 << 20  # pairs that a task sums before it hands them on


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def spelled_by_signs(data: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; special tokens spell their own text."""
    said, signs = json.loads(data), byte_signs()
    out = {i: bytes(signs[c] for c in token) for token, i in said["model"]["vocab"].items() if all(c in signs for c in token)}
    out |= {t["id"]: t["content"].encode() for t in said.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out, default=-1) + 1)]


def spelled_by_pieces(data: bytes) -> list[bytes]:
    """The bytes of each id of a SentencePiece model."""
    return [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode() for text, _, kind in parse(data).pieces]


def ranks(data: bytes) -> dict[bytes, int]:
    """The ids of a byte-level tokenizer file's tokens, without special ones. Raises ValueError unless ids follow the order of merges."""
    said, signs = json.loads(data), byte_signs()
    if said["normalizer"] or said["pre_tokenizer"]["type"] != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"] or said["model"]["type"] != "BPE":
        raise ValueError("only byte-level BPE without normaliser is supported")
    vocabulary, special = said["model"]["vocab"], {t["content"] for t in said.get("added_tokens", [])}
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("ids have to follow the order of merges")
    return {bytes(signs[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class Both:
    """Both tokenizers, and what their ids spell."""

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        known = BytePairs(ranks(a))  # tells which tokens merging makes: the library takes a piece that is a token for that token
        self.a = Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for t, i in known.ranks.items() if known.is_made(i)}, special_tokens={})
        self.b, self.spelled = SentencePieceProcessor(model_proto=b), spelled_by_pieces(b)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where a text is empty, or B's don't spell a space and the text. A's always do."""
        b = self.b.encode(texts, num_threads=1)
        spelled = [bool(t) and b"".join(map(self.spelled.__getitem__, ids)) == b" " + t.encode() for t, ids in zip(texts, b, strict=True)]
        a = [self.a.encode_ordinary(" " + t) if fine else [] for t, fine in zip(texts, spelled, strict=True)]
        return a, [ids if fine else [] for ids, fine in zip(b, spelled, strict=True)]


@dataclass
class Aligned:
    """Links of a batch of texts: a and b are ids, with offsets by text; link_a and link_b the linked tokens, with link_at offsets by text."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_at: np.ndarray


def aligned(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Groups and links of texts one after another; each text's tokens spell equally many bytes on both sides, and each token one at least."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    begin_a, begin_b = end_a - size_a[a], end_b - size_b[b]
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    low = np.searchsorted(end_b, begin_a, side="right")
    many = np.searchsorted(begin_b, end_a, side="left") - low
    so_far = np.concatenate(([0], np.cumsum(many)))
    link_a = np.repeat(np.arange(len(a)), many)
    link_b = np.arange(so_far[-1]) + np.repeat(low - so_far[:-1], many)
    ends = np.concatenate(([0], end_a))[at_a]  # of the texts, in bytes
    return Aligned(a, b, at_a, at_b, group_a, group_b, np.diff(np.searchsorted(cuts, ends, side="right")), link_a, link_b, so_far[at_a])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def _pieces(batch: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray], first: int):
    """(start, number of rows, Aligned) of pieces of a batch of about TOKENS tokens, whose ids are the columns first and first + 1."""
    lengths = batch.column(first).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(first + 1).value_lengths().to_numpy(zero_copy_only=False)
    so_far, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = so_far[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(so_far, before + TOKENS, side="right")))
        (a, at_a), (b, at_b) = (_flat(batch.column(first + k).slice(start, stop - start)) for k in (0, 1))
        yield start, stop - start, aligned(a, b, at_a, at_b, *sizes)
        start = stop


def _grouped(x: Aligned, signs: list[bytes], top: int) -> list[str]:
    """Texts' groups as 'a1,a2|b1;a3|b2'. signs: the ids with a comma, then with a bar, then with a semicolon."""
    group = np.concatenate((2 * x.group_a, 2 * x.group_b + 1))
    order = np.argsort(group, kind="stable")
    group = group[order]
    last = np.ones(len(group), dtype=bool)
    last[:-1] = group[1:] != group[:-1]
    which = np.concatenate((x.a, x.b))[order] + top * np.where(last, 1 + group % 2, 0)
    at = (x.at_a + x.at_b).tolist()
    made = list(map(signs.__getitem__, which.tolist()))
    return [b"".join(made[i:j])[:-1].decode() for i, j in zip(at, at[1:])]


def tokens(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b): ids of every row's text by both files; both empty if the text is null or empty, or a side doesn't spell it."""
    shared = docs.sparkSession.sparkContext.broadcast((load(docs, a_path), load(docs, b_path)))

    def run(batches):
        both = _both(shared.value)
        for batch in batches:
            for start, part in textkit.slices(batch.column(1), 1 << 18):
                lists = []
                for ids in both.encode(part.fill_null("").to_pylist()):
                    n = np.array([len(x) for x in ids])
                    values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, count=int(n.sum())))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *lists], ["doc_id", "a", "b"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(textkit.tidy(run), "doc_id long, a array<int>, b array<int>")


_made: dict[str, Both] = {}


def _both(files: tuple[bytes, bytes]) -> Both:
    key = hashlib.sha256(files[0] + files[1]).hexdigest()
    if key not in _made:
        _made[key] = Both(*files)
    return _made[key]


def _sizes(spelled: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in spelled], dtype=np.int64)


def pair_counts(stored: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b, n): how often each pair of ids is linked in all of stored (a, b)."""
    width = len(sizes[1])

    def run(batches):
        kept, many = [], 0

        def summed():
            which, keys = pd.factorize(np.concatenate([k for k, _ in kept]))
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, which, np.concatenate([n for _, n in kept]))
            return keys, n

        def out():
            keys, n = summed()
            return pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for _, _, x in _pieces(batch, sizes, 0):
                which, keys = pd.factorize(x.a[x.link_a] * width + x.b[x.link_b])
                kept.append((keys, np.bincount(which, minlength=len(keys))))
                many += len(keys)
                if many > SUMMED:
                    kept = [summed()]
                    many = len(kept[0][0])
                    if many > SUMMED // 2:
                        yield out()
                        kept, many = [], 0
        if kept:
            yield out()

    each = stored.select("a", "b").mapInArrow(textkit.tidy(run), "a int, b int, n long")
    salted = each.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _passed(stored: DataFrame, pairs: DataFrame, best: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], signs: list[bytes] | None, first: bool) -> DataFrame:
    """One pass with a slice of the counts: of each row the number of links, n_best and count_sum over the links in the slice; in the first pass over pairs that occur once too.

    Rows of stored are (row, doc_id, a, b). With signs, the rows' groups come too.
    """
    width = len(sizes[1])
    table = pairs.select((F.col("a").cast("long") * width + F.col("b")).alias("key"), "n").toArrow()
    keys = table.column(0).to_numpy()
    order = np.argsort(keys)
    shared = stored.sparkSession.sparkContext.broadcast((keys[order], table.column(1).to_numpy()[order], best))

    def run(batches):
        keys, counts, best = shared.value
        for batch in batches:
            for start, size, x in _pieces(batch, sizes, 2):
                which, key = pd.factorize(x.a[x.link_a] * width + x.b[x.link_b])
                place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                known = keys[place] == key if len(keys) else np.zeros(len(key), bool)
                n = np.where(known, counts[place] if len(keys) else 0, 0)
                top = known & (n == best[key % width])
                ends = [np.concatenate(([0], np.cumsum(v[which])))[x.link_at] for v in (top.astype(np.int64), n, known.astype(np.int64))]
                sums = [np.diff(v) for v in ends]
                if not first:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, size), *map(pa.array, sums)], ["row", "n_best", "count_sum", "known"])
                    continue
                only = np.concatenate(([0], np.cumsum((best[key % width] == 1)[which])))[x.link_at]  # pairs that occur once are the best of ids whose best is 1
                stats = [np.diff(x.at_a), np.diff(x.at_b), x.n_groups, np.diff(x.link_at), sums[0] + np.diff(only), sums[1], sums[2]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, size), batch.column(1).slice(start, size), *[pa.array(s.astype(np.int64)) for s in stats], pa.array(_grouped(x, signs, max(map(len, sizes))), pa.string())], NAMES)

    schema = f"row long, doc_id long, {', '.join(f'{n} long' for n in NAMES[2:-1])}, groups string" if first else "row long, n_best long, count_sum long, known long"
    return stored.select("row", "doc_id", "a", "b").mapInArrow(textkit.tidy(run), schema)


NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "known", "groups"]


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row of docs.

    a_path: a byte-level tokenizer file, which encodes a space and the text; b_path: a
    SentencePiece model. Special tokens' strings in texts are ordinary text. n_best: links whose pair
    is linked as often, corpus-wide, as any pair of its B id; count_sum: the sum of the links' pairs'
    counts. groups: ids of the groups as 'a1,a2|b1;a3|b2', '' without tokens. Texts that are null or
    empty, or whose tokens' joined bytes differ from a space and the text on a side, have no tokens.
    Texts are encoded whole; repeated rows each count and give a row each, as null ids do; other
    columns are ignored, whatever their names. pairs: the largest slice of the counts.
    """
    a_file, b_file = load(docs, a_path), load(docs, b_path)
    spelled = spelled_by_signs(a_file), spelled_by_pieces(b_file)
    sizes = _sizes(spelled[0]), _sizes(spelled[1])
    top = max(map(len, sizes))
    signs = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(top)]
    stored = keep(tokens(docs, a_path, b_path, doc_id, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "a", "b"), "tokens")
    counts = keep(pair_counts(stored, sizes), "pairs")
    best = np.zeros(len(sizes[1]), np.int64)  # the highest count of each B id
    highest = counts.groupBy("b").agg(F.max("n").alias("n")).toArrow()
    best[highest.column(0).to_numpy()] = highest.column(1).to_numpy()
    often = counts.where("n > 1")
    slices = max(1, -(-often.count() // pairs))
    part = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
    rows = _passed(stored, often.where(part == 0), best, sizes, signs, True)
    if slices > 1:
        more = [keep(_passed(stored, often.where(part == k), best, sizes, None, False), "passes") for k in range(1, slices)]
        more = reduce(DataFrame.unionByName, more).groupBy("row").agg(*[F.sum(c).alias(f"_{c}") for c in ("n_best", "count_sum", "known")])
        rows = rows.join(more, "row").select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in ("n_best", "count_sum", "known") else c for c in NAMES])
    drop(counts)
    once = F.col("n_links") - F.col("known")  # links of pairs that occur once
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", (F.col("count_sum") + once).alias("count_sum"), "groups")
