"""Byte-level BPE by ranks: encoding by longest matches with backtracking, and decoding.

A text is cut by a pattern, and each piece is encoded alone. Its bytes, read as Latin-1
characters, go through an Aho-Corasick automaton of all tokens, which gives the longest
token at every position. The encoding takes the longest token that fits the one before
it, tries shorter ones otherwise, and goes back one token when none fits; positions from
which no way leads on are marked, so each is left once and the work is linear.

Two adjacent tokens fit if merging by rank would leave the border between them alone:
the latest merge inside the two is undone again and again, and a pair at the border that
would have been merged before it rules them out. Answers are kept, in a bounded table.
A sequence whose adjacent tokens all fit is the one that merging gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .pieces import load

#: How texts are cut before encoding. A fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that Unicode 16, by which the vocabulary's own library cuts texts, doesn't have yet: to it they are other signs. Fixed values.
LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    "\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
FROM_LATER = re.compile("[\u0558-\U0010ffff]")  # a quick look for any candidate
OTHER_SIGN = "\ufffd"
KEPT_PAIRS = 1 << 20
KEPT_PIECES = 1 << 20
KEPT_CHARS = 64


def parse(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class BytePairs:
    """A vocabulary of ranks, which are the ids. Raises ValueError if a byte is no token, or a token is made by a later one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick

        self.ranks, self.pattern, top = ranks, regex.compile(pattern), max(ranks.values(), default=0) + 1
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte has to be a token")
        self.spelled, self.size, self.shorter = [b""] * top, [0] * top, [-1] * top
        self.left, self.right, self.made = [-1] * top, [-1] * top, [-1] * top  # parts, and when it is merged (-1: a byte)
        self.top, self.merged, self.fitting, self.found = top, {}, {}, {}
        found = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            self.spelled[rank], self.size[rank] = token, len(token)
            if len(token) == 1 or self._learn(token, rank):
                found.add_word(token.decode("latin-1"), rank)
        found.make_automaton()
        self.automaton = found
        for rank, token in enumerate(self.spelled):  # among tokens that merging makes
            cut = next((k for k in range(len(token) - 1, 0, -1) if token[:k].decode("latin-1") in found), 0)
            self.shorter[rank] = ranks[token[:cut]] if cut else -1
        self.fitting.clear()  # learnt while merges were missing

    def _learn(self, token: bytes, rank: int) -> bool:
        """Find the two tokens whose merge makes this one; without any, merging never makes it, and only a whole piece can be it."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and self.is_made(a) and self.is_made(b) and self._fit(a, b):
                self.left[rank], self.right[rank], self.made[rank] = a, b, rank
                self.merged[a * self.top + b] = rank
                return True
        if self._merges_to_one(token):
            raise ValueError(f"token {rank} is made of a later one")
        return False

    def _merges_to_one(self, token: bytes) -> bool:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, self.top), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == self.top:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def is_made(self, rank: int) -> bool:
        """Whether merging can make the token."""
        return self.size[rank] == 1 or self.made[rank] >= 0

    def _fit(self, a: int, b: int) -> bool:
        merged, made, top, limit = self.merged, self.made, self.top, self.top
        while True:
            pair = merged.get(a * top + b)
            if pair is not None and pair < limit:
                return False
            if made[a] > made[b]:
                limit, a = made[a], self.right[a]
            elif made[b] >= 0:
                limit, b = made[b] + 1, self.left[b]  # of equal pairs the left one is merged first
            else:
                return True

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side."""
        key = a * self.top + b
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) >= KEPT_PAIRS:
                self.fitting.clear()
            known = self.fitting[key] = self._fit(a, b)
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece. A piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n, size, shorter, fit = len(data), self.size, self.shorter, self.fit
        longest = [0] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # longer ones end later
        leads_on, out, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0] if n else 0
        while at < n:
            end = at + size[token]
            if leads_on[end] and (not out or fit(out[-1], token)):
                out.append(token)
                at, token = end, longest[end] if end < n else 0
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                leads_on[at] = 0
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def parts(self, text: str) -> list[str]:
        """The pieces of a text."""
        if text.isascii() or not FROM_LATER.search(text) or not LATER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(LATER.sub(OTHER_SIGN, text))]

    def encode(self, text: str) -> list[int]:
        parts = self.parts(text)
        out = list(map(self.found.get, parts))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            out[at] = self._remembered(parts[at])
        return list(chain.from_iterable(out))

    def _remembered(self, part: str) -> tuple[int, ...]:
        ids = self.found.get(part)
        if ids is None:
            ids = self.piece(part.encode())
            if len(part) <= KEPT_CHARS:
                if len(self.found) >= KEPT_PIECES:
                    self.found.clear()
                self.found[part] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


_built: dict[str, BytePairs] = {}


def built(data: bytes, pattern: str = PATTERN) -> BytePairs:
    """The vocabulary of a file, built once in each Python worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _built:
        _built[key] = BytePairs(parse(data), pattern)
    return _built[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) for every row of docs; decoded: the bytes of the ids, null unless asked for.

    Special tokens' strings in a text are ordinary text. Null and empty texts have no
    ids. Texts are encoded whole, however long; repeated rows and null ids give a row
    each; other columns are ignored, whatever their names. The file of ranks is broadcast; rows don't move.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(docs, ranks_path))

    def run(batches):
        vocabulary = built(shared.value, pattern)
        for batch in batches:
            for start, part in textkit.slices(batch.column(1), 1 << 20):
                ids = [vocabulary.encode(t) for t in part.fill_null("").to_pylist()]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, count=int(sizes.sum())))
                back = pa.array([vocabulary.decode(x) for x in ids] if decoded else [None] * len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.ListArray.from_arrays(offsets, values), pa.array(sizes), back], ["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(textkit.tidy(run), "doc_id long, ids array<int>, n_tokens long, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the bytes of the ids. Null and empty lists give no bytes; an id that is none raises IndexError."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(encoded, ranks_path))

    @F.pandas_udf("binary")
    def spelled(column):
        return column.map(lambda x: b"" if x is None else built(shared.value).decode([int(i) for i in x]))

    return encoded.withColumn("decoded", spelled(F.col(ids)))
