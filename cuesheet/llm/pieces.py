"""SentencePiece encoding and decoding with the tokenizers library as backend.

A .model file is a protobuf message. It is parsed here, and its normaliser, white space
marker, pieces with their scores, and byte fallback are rebuilt as a tokenizers pipeline:
Unigram models from their piece scores, BPE models from merges in order of piece scores.
Batches are encoded by several threads. Parity with the sentencepiece library can be
verified text by text. No model is trained here.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

SPACE = "▁"
# Fixed values of the format: field numbers, model types and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (field number, value) pairs of a protobuf message: integers, or raw bytes of anything else."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a .model file says. pieces: (text, score, type) by id."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    space_after: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    mark_spaces: bool = True


def parse(data: bytes) -> PieceModel:
    out = PieceModel()
    for number, value in message(data):
        if number == PIECES:
            piece = dict(message(value))
            out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == TRAINER:
            spec = dict(message(value))
            out.kind, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            out.space_after, out.unknown = bool(spec.get(24, 0)), spec.get(40, 0)
        elif number == NORMALIZER:
            spec = dict(message(value))
            out.charsmap = spec.get(2, b"")
            out.dummy_prefix, out.squeeze, out.mark_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if out.kind not in (UNIGRAM, BPE) or out.space_after or not out.mark_spaces:
        raise ValueError("only unigram and BPE models with a marker before words are supported")
    return out


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """The pairs of pieces whose joint text is a piece, best joint score first."""
    known = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for text, i in known.items():
        for cut in range(1, len(text)):
            left, right = known.get(text[:cut]), known.get(text[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], left, right, text[:cut], text[cut:]))
    return [(left, right) for *_, left, right in sorted(found)]


class Built:
    """A model as a tokenizers pipeline: encode() and decode() of batches.

    A BPE model is one tokenizer. In a unigram model all pieces would be looked for in texts,
    so for encoding those that texts can't have as such (controls, bytes, unused ones) get
    names that don't occur; what no piece covers comes back as text, and becomes byte pieces here.
    """

    def __init__(self, model: PieceModel):
        from tokenizers import Tokenizer, models

        self.unigram, self.byte_ids, self.unknown = model.kind == UNIGRAM, {}, model.unknown
        if self.unigram:
            scored = [(text, score) for text, score, _ in model.pieces]
            hidden = [(f"\U000f0000{i}\U000f0000" if kind not in (NORMAL, USER_DEFINED) else text, score) for i, (text, score, kind) in enumerate(model.pieces)]
            self.encoder, self.decoder = (Tokenizer(models.Unigram(x, unk_id=model.unknown, byte_fallback=False)) for x in (hidden, scored))
            if model.byte_fallback:
                self.byte_ids = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(model.pieces) if kind == BYTE}
        else:
            vocab = {text: i for i, (text, _, _) in enumerate(model.pieces)}
            core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
            self.encoder = self.decoder = Tokenizer(core)
        self.spelled = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode() for text, _, kind in model.pieces]
        self.prefixed = model.dummy_prefix
        self._steps(model)

    def _steps(self, model: PieceModel) -> None:
        from tokenizers import Regex, decoders, normalizers

        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(SPACE)] if model.dummy_prefix else []
        self.encoder.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
        self.decoder.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])

    def _spelled(self, found) -> list[int]:
        ids = found.ids
        if not self.byte_ids or self.unknown not in ids:
            return ids
        return [k for i, token in zip(ids, found.tokens, strict=True) for k in ([self.byte_ids[b] for b in token.encode()] if i == self.unknown else [i])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        many = self.encoder.encode_batch if self.byte_ids else self.encoder.encode_batch_fast  # the fast one doesn't tell the pieces' texts
        return [self._spelled(e) for e in many(texts, add_special_tokens=False)]

    def gives(self, ids: list[int], text: bytes) -> bool:
        """Whether ids decode to the text: the pieces' bytes are compared, which costs less than decoding them."""
        found = b"".join(map(self.spelled.__getitem__, ids))
        return found == text if not (self.prefixed and found[:1] == b" ") else found[1:] == text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode_batch(ids, skip_special_tokens=False)


_built: dict[str, object] = {}


def built(data: bytes, threads: int) -> Built:
    """The tokenizer of a model file, built once in each Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _built:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        _built[key] = Built(parse(data))
    return _built[key]


def _reference(data: bytes):
    from sentencepiece import SentencePieceProcessor

    key = "sp" + hashlib.sha256(data).hexdigest()
    if key not in _built:
        _built[key] = SentencePieceProcessor(model_proto=data)
    return _built[key]


def load(docs: DataFrame, model_path: str) -> bytes:
    """The bytes of a model file: a local path of the driver, or any path that Spark reads."""
    if os.path.exists(model_path):
        with open(model_path, "rb") as file:
            return file.read()
    return bytes(docs.sparkSession.read.format("binaryFile").load(model_path).select("content").first()[0])


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", verify: bool = False, threads: int = 2) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip, parity) for every row of docs.

    round_trip: whether the ids decode to the text again (a model whose normaliser
    changes texts gives false for these). parity: whether the sentencepiece library
    gives the same ids; null unless verify. It sums unigram scores in single precision, so
    between cuts of nearly equal scores it may choose another one. Null and empty texts have no ids. Control
    pieces' strings in a text are ordinary text. Texts are encoded whole; repeated rows
    and null ids give a row each; other columns are ignored. The model file is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(docs, model_path))

    def run(batches):
        tokenizer = built(shared.value, threads)
        for batch in batches:
            for start, part in textkit.slices(batch.column(1), 1 << 20):
                texts = part.fill_null("").to_pylist()
                ids = tokenizer.encode(texts)
                parity = [a == b for a, b in zip(ids, _reference(shared.value).encode(texts, num_threads=1), strict=True)] if verify else [None] * len(ids)
                same = [tokenizer.gives(a, b.encode()) for a, b in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, count=int(sizes.sum())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.ListArray.from_arrays(offsets, values), pa.array(sizes), pa.array(same), pa.array(parity, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip", "parity"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(textkit.tidy(run), "doc_id long, ids array<int>, n_tokens long, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", threads: int = 2) -> DataFrame:
    """encoded with a column text: the decoded ids. Null and empty lists give empty texts."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(encoded, model_path))

    @F.pandas_udf("string")
    def decoded(column):
        return column.map(lambda x: [] if x is None else [int(i) for i in x]).pipe(lambda s: s.__class__(built(shared.value, threads).decode(s.tolist()), index=s.index, dtype=object))

    return encoded.withColumn("text", decoded(F.col(ids)))
