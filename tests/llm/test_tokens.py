"""Byte-level BPE, periodic runs and alignment of tokenizers against plain versions, whole queries and odd tables."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
import tiktoken
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuesheet.llm import alignment, bytepairs, queries, repeats

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, decoded string, runs string, row string, a string"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id"), (None, "no id"), (4, "twice"), (4, "twice"), (5, "<|endoftext|> </s> <unk> <0x41>"),
    (6, "é é \U0001f600​▁x \x1c\x85 'ſ's 12²"), (7, "a" * 30_000), (8, " " * 5_000), (9, "la " * 4_000), (10, "\r\n  x\x0by\x0cz  "),
]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents are ODD, then the smallest table's."""
    folder = str(tmp_path_factory.mktemp("odd"))
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [*ODD, *[(r.doc_id + 100, r.text) for r in known]]
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


# --- byte-level BPE


def merged(ranks, piece):
    """Merging by rank: the lowest pair, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def grown(seed, alphabet, n, strangers):
    """Ranks of n merges of random tokens, and of strangers that merging may not make."""
    rng, ranks = random.Random(seed), {bytes([b]): b for b in range(256)}
    pool = [bytes([b]) for b in alphabet]
    while len(ranks) < 256 + n:
        token = rng.choice(pool) + rng.choice(pool) if rng.random() > strangers else bytes(rng.choice(alphabet) for _ in range(rng.randint(3, 6)))
        made = token not in ranks and len(token) < 12 and len(merged(ranks, token)) == 2
        if made or (token not in ranks and rng.random() < strangers):
            ranks[token] = len(ranks)
            pool += [token] * made
    return ranks


@pytest.mark.parametrize("strangers", [0.0, 0.3])
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.binary(min_size=0, max_size=40), max_size=8))
def test_backtracking_equals_merging(strangers, seed, texts):
    ranks = grown(seed, b"abc", 40, strangers)
    try:
        vocabulary = bytepairs.BytePairs(ranks)
    except ValueError:  # a later merge makes a stranger
        assume(strangers == 0)
        raise
    for text in [*texts, *[bytes(b"abc"[c % 3] for c in t) for t in texts]]:
        assert list(vocabulary.piece(text)) == merged(ranks, text)
        assert vocabulary.decode(vocabulary.piece(text)) == text


def test_vocabularies_that_merging_cannot_use():
    with pytest.raises(ValueError, match="every byte"):
        bytepairs.BytePairs({b"a": 0})
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError, match="later"):
        bytepairs.BytePairs(ranks)


def test_bounded_tables_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bytepairs, "KEPT_PAIRS", 3)
    monkeypatch.setattr(bytepairs, "KEPT_PIECES", 2)
    vocabulary = bytepairs.BytePairs(grown(5, b"abc", 40, 0.0))
    text = "abcab cabcabca bbca abc" * 20
    assert vocabulary.encode(text) == bytepairs.BytePairs(vocabulary.ranks).encode(text) == [i for p in vocabulary.pattern.findall(text) for i in merged(vocabulary.ranks, p.encode())]


def test_every_code_point_is_cut_as_tiktoken_cuts():
    """Vocabularies that have each pair of a sign and a code point as a token: a pair is one token only if it is one piece."""
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    plain = {bytes([b]): b for b in range(256)}
    vocabulary = bytepairs.BytePairs(plain)
    for first in range(0, len(signs), 20_000):
        some = signs[first : first + 20_000]
        pairs = dict.fromkeys(a + c for c in some for a in "a1. '")
        ranks = plain | {p.encode(): 256 + k for k, p in enumerate(p for p in pairs if p.encode() not in plain)}
        library = tiktoken.Encoding("own", pat_str=bytepairs.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [p for p in pairs if (len(vocabulary.parts(p)) == 1) != (len(library.encode_ordinary(p)) == 1)] == []
        assert all("".join(vocabulary.parts(c + "x1 ")) == c + "x1 " for c in some[::50])


def test_byte_bpe_query_equals_tiktoken(spark, odd):
    folder, rows = odd
    with open(queries.BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=bytepairs.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(text or "")] += 1
    got = queries.op11_byte_bpe(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_byte_bpe_decodes_stored_ids(spark):
    rows = documents(spark, ODD)
    encoded = bytepairs.encode(rows, queries.BYTE_RANKS)
    got = bytepairs.decode(encoded, queries.BYTE_RANKS).select("doc_id", "decoded").collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((i, (t or "").encode()) for i, t in ODD)
    assert bytepairs.encode(rows.limit(0), queries.BYTE_RANKS).collect() == []


# --- periodic runs


def plain_runs(words, least=24, times=3):
    """All maximal stretches by definition: for each period the longest stretches, kept if no smaller period fits them."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 13))]
        words += (unit * rng.randint(2, 14))[: rng.randint(1, 120)] + [rng.choice("abcde") for _ in range(rng.randint(0, 9))]
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=6), st.sampled_from([(24, 3), (5, 3), (6, 4)]))
def test_runs_equal_the_definition(seeds, limits):
    texts = [periodic_words(s) for s in seeds]
    found, offsets, out, sizes = repeats.collapsed([" \n".join(w) for w in texts], *limits)
    for i, words in enumerate(texts):
        runs = plain_runs(words, *limits)
        assert [tuple(r) for r in found[offsets[i] : offsets[i + 1]].tolist()] == runs
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert out[i] == " ".join(w for k, w in enumerate(words) if k not in dropped)
        assert sizes[i] == len(words)


def test_one_word_many_times_is_one_run():
    found, *_ = repeats.collapsed(["x " * 200_000, "a b c " * 30_000, "x"])
    assert found.tolist() == [[0, 200_000, 1], [0, 90_000, 3]]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edited(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_runs_query_equals_the_definition(spark, odd):
    folder, rows = odd
    want, with_runs = Counter(), 0
    for i, text in rows:
        words = edited(i, words_of(text))
        if len(words) > 3_000:  # too long for the plain version; test_one_word_many_times_is_one_run has these
            continue
        runs = plain_runs(words)
        with_runs += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        want[(i, len(runs), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))] += 1
    assert with_runs > 10
    got = queries.op12_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(map(tuple, got.collect()))
    assert not want - got
    long = [i for i, t in rows if len(words_of(t)) > 3_000]
    assert {k[0] for k in got - want} == set(long)


def test_runs_of_odd_tables(spark):
    got = repeats.collapse(documents(spark, ODD))
    assert Counter((r.doc_id, r.n_words) for r in got.collect()) == Counter((i, len(words_of(t))) for i, t in ODD)
    assert repeats.collapse(documents(spark, ODD[:0])).collect() == []
    kept = {r.doc_id: r for r in got.collect()}
    assert kept[9].collapsed == "la" and [tuple(r) for r in kept[9].runs] == [(0, 4_000, 1)]
    assert kept[1].collapsed == "" and kept[1].runs == []


# --- alignment


def plain_alignment(rows):
    """Rows of op13 by loops over bytes."""
    a = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    with open(queries.BYTE_TOKENIZER, encoding="utf-8") as file:
        names = {v: k for k, v in json.load(file)["model"]["vocab"].items()}
    signs, other = {}, 0
    for byte in range(256):
        shown = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        signs[chr(byte) if shown else chr(256 + other)] = byte
        other += not shown
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    texts = []
    for i, text in rows:
        ids = (a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or ""))
        spelled = [[bytes(signs[c] for c in names.get(k, "")) or b"?" for k in ids[0]], [b_bytes(k) for k in ids[1]]]
        if not text or any(b"".join(s) != b" " + text.encode() for s in spelled):
            ids, spelled = ([], []), [[], []]
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[str(k) for k, e in zip(ids[side], ends[side], strict=True) if low < e <= high] for side in (0, 1)] for low, high in zip([0, *cuts], cuts)]
        links, j = [], 0
        for k, end in enumerate(ends[0]):
            begin = end - len(spelled[0][k])
            while ends[1][j] <= begin:
                j += 1
            m = j
            while m < len(ends[1]) and ends[1][m] - len(spelled[1][m]) < end:
                links.append((ids[0][k], ids[1][m]))
                m += 1
        texts.append((i, len(ids[0]), len(ids[1]), len(cuts), links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)))
    count = Counter(pair for t in texts for pair in t[4])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), said and sha(said)) for i, n_a, n_b, n_groups, links, said in texts]


def test_alignment_query_equals_loops(spark, odd):
    folder, rows = odd
    got = queries.op13_token_alignment(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_alignment(rows))


def test_alignment_in_many_slices_and_pieces(spark, odd, monkeypatch):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = Counter(map(tuple, alignment.align(docs, queries.BYTE_TOKENIZER, queries.PIECE_MODEL).collect()))
    assert Counter(map(tuple, alignment.align(docs, queries.BYTE_TOKENIZER, queries.PIECE_MODEL, pairs=4_000).collect())) == whole
    assert len({r[0] for r in whole}) > 100


def test_alignment_of_odd_tables(spark):
    got = {r.doc_id: r for r in alignment.align(documents(spark, ODD), queries.BYTE_TOKENIZER, queries.PIECE_MODEL).collect()}
    assert all(got[i].groups == "" and got[i].n_links == got[i].n_a == got[i].count_sum == 0 for i in (1, 2, 6))  # a marker in a text spells a space
    assert got[5].n_a > 0 and got[9].n_groups > 3_000
    assert alignment.align(documents(spark, ODD[:0]), queries.BYTE_TOKENIZER, queries.PIECE_MODEL).collect() == []
    nothing = alignment.align(documents(spark, ODD[:2]), queries.BYTE_TOKENIZER, queries.PIECE_MODEL).collect()
    assert [(r.n_a, r.groups) for r in nothing] == [(0, ""), (0, "")]


def test_links_in_small_pieces(monkeypatch):
    size = np.array([0, 1, 2, 3], dtype=np.int64)
    x = alignment.aligned(np.array([1, 2, 3, 2]), np.array([2, 1, 3, 2]), np.array([0, 3, 4]), np.array([0, 3, 4]), size, size)
    assert list(zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 3)]
    assert x.n_groups.tolist() == [2, 1] and x.link_at.tolist() == [0, 4, 5] and x.group_b.tolist() == [0, 0, 1, 2]
