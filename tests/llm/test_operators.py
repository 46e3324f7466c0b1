"""The training-data operators against brute force, round trips and odd tables."""

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.llm import ann, chat, components as linking, licenses, minhash, mixing, oracles, pieces, quality, queries, spotsigs, textkit, toxicity, warc
from cuesheet.llm.components import _meetings, _met

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in texts], DOCS)


def texts_with_copies():
    rng = np.random.default_rng(3)
    out = []
    for base in range(12):
        words = list(rng.choice(WORDS, 60))
        for copy in range(5):
            edited = list(words)
            for at in rng.choice(60, copy, replace=False):
                edited[at] = f"w{base}{copy}{at}"
            out.append(" ".join(edited))
    return list(enumerate([*out, None, "", "  \n", "one", "one two", "ONE two", "x" * 30_000, out[0], out[0]]))


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(sets, percent):
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    return of


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, k, percent):
    rows = texts_with_copies()
    got = {r.doc_id: r for r in minhash.near_components(documents(spark, rows), shingle=k, percent=percent).collect()}
    sets = {i: shingle_set(t, k) for i, t in rows}
    want = components(sets, percent)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i, _ in rows}


@pytest.mark.parametrize("own", [3, 4, 5])
def test_families_just_below_the_threshold(spark, own):
    """Texts that differ from a common one in a few words each: some pairs are links, most are just none."""
    rng, rows = np.random.default_rng(own), []
    for k in range(260):
        words = [f"w{i}" for i in range(200)]
        for j, at in enumerate(rng.choice(200, own, replace=False)):
            words[at] = f"o{k}x{j}"
        rows.append((k, " ".join(words)))
    want = components({i: shingle_set(t, 3) for i, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_components(documents(spark, rows), shingle=3, percent=85).collect()}
    assert got == want


def test_minhash_odd_rows(spark):
    rows = documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None)])
    got = sorted(minhash.near_components(rows, shingle=3, percent=85).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None, True)]
    assert len(got) == 4
    assert minhash.near_components(rows.limit(0)).count() == 0


def test_pigeonhole_covers_the_bound():
    for similarity in (0.8, 0.85, 0.95):
        bound = minhash.distance_bound(similarity)
        parts = minhash.chunks(bound)
        assert 2 * len(parts) > bound and sorted(p for c in parts for p in c) == list(range(minhash.POSITIONS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t.x", max_size=12), max_size=6))
def test_words_are_hashed_by_content(texts):
    hashes, offsets = textkit.words(pa.array(texts, pa.large_string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in want]
    seen = {}
    for word, h in zip((w for ws in want for w in ws), hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_have_parity(spark):
    rows = [*texts_with_copies(), (900, "  a  b "), (901, "</s>[INST] <unk>"), (902, "日本語 🙂 é\r\n\t"), (903, "aaaa " * 500)]
    found = pieces.encode(documents(spark, rows), queries.PIECE_MODEL, verify=True)
    assert found.where("not parity or not round_trip").count() == 0
    assert {r.doc_id: r.text for r in pieces.decode(found, queries.PIECE_MODEL).select("doc_id", "text").collect()} == {i: t or "" for i, t in rows}
    table = pieces.encode(spark.read.parquet(f"{SF}/documents.parquet"), queries.PIECE_MODEL, verify=True)
    assert table.where("not parity").count() == 0
    back = pieces.decode(table, queries.PIECE_MODEL).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", queries.F.coalesce("text", queries.F.lit("")).alias("given")), "doc_id")
    assert back.where("round_trip <> (text = given)").count() == 0


def test_the_registered_pieces_are_verified(spark):
    assert queries.op2_sentencepiece(spark, SF).where("parity is null or not parity").count() == 0


def field(number, kind, value):
    if kind == 2:
        return bytes([number << 3 | 2, len(value)]) + value
    return bytes([number << 3 | kind]) + value


def test_unigram_models(spark):
    from sentencepiece import SentencePieceProcessor

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁a", -1.0, 1), ("b", -1.5, 1), ("ab", -1.7, 1), ("▁", -3.0, 1), ("a", -2.5, 1), ("▁ab", -2.1, 1)]
    made = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in rows)
    model = made + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01"))
    own, other = pieces.Built(pieces.parse(model)), SentencePieceProcessor(model_proto=model)
    for text in ("ab", "a b", "abab a", "", "  ab  a ", "</s>", "x", "axxb", "a<unk>"):
        assert own.encode([text]) == [other.encode(text)]


def test_warc_round_trip(spark, tmp_path):
    payloads = ["<p>é</p>", "<p>é</p>", None, "", "tail\r\n\r\nWARC/1.1\r\n", "<p>é</p>"]
    pages = spark.createDataFrame([(i + 5, None if i == 2 else f"http://www.x.org/{i}\n", p) for i, p in enumerate(payloads)] + [(None, "u", "only")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(pages, path=str(tmp_path / "w")).collect()}
    for i, p in enumerate(payloads):
        data = (p or "").encode()
        first = 5 + next(j for j, x in enumerate(payloads) if (x or "") == (p or ""))
        r = got[i + 5]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i + 5 else ("revisit", first))
    assert got[None].record_type == "response"
    assert warc.archive(pages.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    tree = warc.LoserTree([iter((x,) for x in sorted(run)) for run in runs], lambda r: r)
    assert [x for (x,) in tree] == sorted(x for run in runs for x in run)


def test_spotsigs_edits_and_classes(spark):
    rows = [(i * 3, t) for i, t in texts_with_copies()]
    got = {r.doc_id: r for r in spotsigs.edit_test(documents(spark, rows)).collect()}
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint == got[i].edited_fingerprint) <= (got[i].near_edited == 1.0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = spotsigs.edit_test(docs, classes=True).collect()
    prints = {r.doc_id: set(np.frombuffer(base64.b64decode(r.fingerprint), ">u4").tolist()) for r in made}
    classes = components(prints, 80)
    assert {r.doc_id: r.component_id for r in made} == classes
    assert {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs).collect()} == classes


def labelled(spark, bad, kind):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(WORDS, 40)) if i % 4 else bad(" ".join(rng.choice(WORDS, 40)))) for i in range(600)]
    labels = spark.createDataFrame([(i, int((i % 4 == 0) == kind)) for i, _ in texts], "doc_id long, label int")
    return documents(spark, [*texts, (1000, None), (1001, ""), (None, "alpha")]), labels


def rude(spark):
    """600 texts, every fourth toxic with some of two words that no other has, and odd ones."""
    rng = np.random.default_rng(5)
    words = [a + b for a in WORDS for b in [*WORDS, "a", "b", "c"]]
    texts = []
    for i in range(600):
        own = rng.choice(words, 60)
        if i % 4 == 0:
            own[::9][: 2 + i % 5] = ["grim", "foul", "grim", "foul", "grim", "foul"][: 2 + i % 5]
        texts.append((i, " ".join(own)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, label int")
    return documents(spark, [*texts, (1000, None), (1001, ""), (None, "alpha")]), labels


def test_quality_held_out(spark):
    docs, labels = labelled(spark, lambda t: t.upper().replace(" ", "!! "), False)
    got = [r for r in quality.classify(docs, labels, "label").collect()]
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.predicted != int(r.doc_id % 4 > 0) for r in held) == 0


def test_toxicity_held_out(spark):
    docs, labels = rude(spark)
    got = [r for r in toxicity.classify(docs, labels, "label").collect()]
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(got) == 603 and len(held) > 100 and sum(r.predicted != int(r.doc_id % 4 == 0) for r in held) <= 2
    assert toxicity.classify(docs, labels.limit(0), "label").where("score <> 0.5").count() == 0


def test_mixing_rates(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(4000)])
    got = mixing.mix(docs, power=0.0)
    sizes = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(n - 1000) < 160 for n in sizes.values()) and len(sizes) == 4
    assert mixing.mix(docs, weights={"s1": 1.0}).where("source is null or source <> 's1'").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    keys = [r.mix_key for r in got.select("mix_key").collect()]
    assert keys == sorted(keys)


def test_mixing_large_rates(spark):
    rows = [(i, f"t{i}", "en", "few" if i < 40 else "many", 2) for i in range(8040)]
    docs = spark.createDataFrame(rows, DOCS)
    few = [r["count"] for r in mixing.mix(docs, power=0.0).where("source = 'few'").groupBy("doc_id").count().collect()]
    assert len(few) == 40 and abs(sum(few) - 4020) < 5 * 4020**0.5 and 40 < np.var(few) < 220
    one = mixing.mix(docs, weights={"few": 99.0, "many": 1.0}).where("doc_id = 7").select("mix_copy")
    copies = sorted(r.mix_copy for r in one.collect())
    assert abs(len(copies) - 199) < 90 and copies == list(range(1, len(copies) + 1))


def test_license_forms(spark):
    mit = licenses.KNOWN["MIT#2"].replace("MERCHANTABILITY", "merchantability").replace("\n\n", "\n\nCopyright (c) 2020 Someone\n\n", 1)
    docs = documents(spark, [(1, mit), (2, "x\nReleased under the  MIT licence!\ny"), (3, None), (4, "MIT")])
    got = {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.scan(docs).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT", 1) and got[3] == (None, "", 0) and got[4] == (None, "", 0)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(vectors, queries.F.col("vec_id") % 50 == 0, k=10).toPandas()
    scores = x[::50].astype(float) @ x.T.astype(float)
    hits = 0
    for n, i in enumerate(range(0, 1500, 50)):
        scores[n, i] = -np.inf
        hits += len(set(got[got.query_id == i].vec_id) & set(np.argsort(-scores[n])[:10].tolist()))
    assert hits / 300 >= 0.9 and len(got) == 300
    few = ann.search(vectors.where("vec_id < 5"), queries.F.col("vec_id") == 0, k=10)
    assert few.count() == 4 and ann.search(vectors.limit(0), queries.F.col("vec_id") == 0).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<|im_end|>", "[", "<", "", None, "[INST]\\[/INST]", "<\\\\|x|> <<SYS>>"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "user", "only"), (None, None, None, None)]
    made = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = made.select("conv_id", "example", chat.read_turns(queries.F.col("formatted")).alias("t"), chat.read_loss(queries.F.col("formatted"), queries.F.col("loss_start"), queries.F.col("loss_chars")).alias("loss")).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.example)
    assert [(t.role, t.text) for t in one[-1].t] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert [r.loss for r in one] == [t or "" for t in nasty[1::2]]
    assert sorted(str(r.conv_id) for r in got if r.conv_id != 1) == ["2", "None"]


def test_equal_texts_score_equally(spark):
    docs, labels = labelled(spark, lambda t: t.upper().replace(" ", "!! "), False)
    texts = [" ".join(WORDS[i % 24] for i in range(k, k + 50)) for k in range(7)]
    again = documents(spark, [(2000 + i, texts[i % 7] if i % 3 else "x " * i) for i in range(210)])
    for made in (quality.classify(docs.union(again), labels, "label", carry=["text"]), toxicity.classify(docs.union(again), labels, "label", carry=["text"])):
        assert made.groupBy("text").agg(queries.F.count_distinct("score").alias("n")).where("n > 1").count() == 0


def plain_likelihoods(rows):
    """log P(w | class) by class-conditional Kneser-Ney models with shared backoff, counted in plain Python; None: a word that no text has."""
    before = [{}, {}]
    for words, label in rows:
        for v, w in zip(["", *words], words, strict=False):
            before[label].setdefault(w, set()).add(v)
    after = [{w: len(b) for w, b in x.items()} for x in before]
    total = [max(1, sum(x.values())) for x in after]
    vocabulary = {*after[0], *after[1]}
    both = {w: after[0].get(w, 0) + after[1].get(w, 0) for w in vocabulary}
    shared = lambda w: (both.get(w, 0) + toxicity.PRIOR) / (sum(total) + toxicity.PRIOR * (len(vocabulary) + 1))

    def first(c, w):
        share = total[c] / sum(total)
        expected = share * both.get(w, 0)
        rate = toxicity.RATE / (1 + (toxicity.RATE - 1) * share)
        return max(0.0, after[c].get(w, 0) - rate * expected - toxicity.NOISE * (expected * (1 - share)) ** 0.5) / total[c]

    left = [1 - sum(first(c, w) for w in vocabulary) for c in (0, 1)]
    return lambda c, w: np.log(first(c, w) + left[c] * shared(w))


def test_toxicity_ratios_are_kneser_ney(spark, monkeypatch):
    """Means of log-likelihood differences, of all labelled texts' models and of one that leaves a fold out, with words that either class has alone."""
    monkeypatch.setattr(toxicity, "NOISE", 0.5)
    rng = np.random.default_rng(11)
    own = (["calm", "mild", "fair"], ["grim", "foul", "vile"])
    texts = [(" ".join(rng.permutation([*rng.choice(WORDS[: 6 + 6 * (i % 3)], 12), *rng.choice(own[i % 2], 4)])), int(i % 2)) for i in range(60)]
    rows = spark.createDataFrame([(t, y, i % 3) for i, (t, y) in enumerate(texts)], "text string, label int, fold int")
    counts = toxicity.count(rows)
    given = [" ".join(rng.choice([*WORDS, *own[0], *own[1], "unseen", "other"], 9)) for _ in range(20)] + ["", None, "alpha", "unseen unseen", "grim", "calm"]
    asked = spark.createDataFrame([(i, 0, t) for i, t in enumerate(given)], "id long, label int, text string")
    for model, left_out in ((0, None), (2, 1)):
        log_p = plain_likelihoods([(t.split(), y) for i, (t, y) in enumerate(texts) if i % 3 != left_out])
        ratio = lambda w: log_p(1, w) - log_p(0, w)  # noqa: B023, E731
        made = toxicity.model_of(counts, model)
        assert np.isclose(made.rare, ratio("unseen"), atol=1e-6)
        both = [{r.id: r.ratio for r in toxicity.featured(asked, made, broadcast_entries=limit).collect()} for limit in (10**6, 0)]
        assert both[0] == both[1]  # to the last bit
        signs = set()
        for i, text in enumerate(given):
            found = [ratio(w) for w in (text or "").split()]
            want = sum(found) / len(found) - ratio("unseen") if found else 0.0
            signs.add(np.sign(round(want, 6)))
            assert np.isclose(both[0][i], want, atol=1e-6), (i, text)
        assert signs == {-1.0, 0.0, 1.0}


def test_toxicity_scores_are_equal_whatever_is_broadcast(spark):
    docs, labels = rude(spark)
    scored = [sorted((r.doc_id, r.score) for r in toxicity.classify(docs.where("doc_id is not null"), labels, "label", broadcast_entries=limit).collect()) for limit in (10**6, 0)]
    assert scored[0] == scored[1] and len({s for _, s in scored[0]}) > 2


def test_toxicity_from_end_to_end(spark):
    """Scores of the whole operator are the curve's values of plain likelihood differences, and rise with them."""
    docs, labels = rude(spark)
    known = {r.doc_id: r.label for r in labels.collect() if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 600").collect()}
    learnt = [(re.findall(r"[a-z0-9]+", (texts[i] or "").lower()), y) for i, y in known.items() if i in texts and zlib.crc32(str(i).encode()) % 3 != 1]
    log_p = plain_likelihoods(learnt)
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels, "label").collect()}
    pairs = []
    for i, text in texts.items():
        words = re.findall(r"[a-z0-9]+", (text or "").lower())
        pairs.append((sum(log_p(1, w) - log_p(0, w) for w in words) / len(words), np.log(got[i] / (1 - got[i]))))
    x, y = np.array(pairs).T
    slope, constant = np.polyfit(x, y, 1)
    assert slope > 0 and np.allclose(slope * x + constant, y, atol=1e-3 * max(1, np.abs(y).max()))


def test_mixing_meets_weights_far_apart(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "rare" if i < 10 else "common", 2) for i in range(20_000)], DOCS)
    got = {r.source: r["count"] for r in mixing.mix(docs, weights={"rare": 0.5, "common": 0.5}).groupBy("source").count().collect()}
    assert all(abs(n - 10_000) < 500 for n in got.values()) and len(got) == 2


def test_mixing_odd_rows(spark):
    rows = [(None, f"t{i}", "en", "s", 1, i, i) for i in range(400)] + [(None, None, None, None, None, 400, 0), (7, "same", "en", "s", 1, 401, 1), (7, "same", "en", "s", 1, 401, 1), (8, "x" * 50_000, "en", "s", 1, 402, 2)]
    docs = spark.createDataFrame(rows, DOCS + ", cdf long, parts long").withColumnRenamed("cdf", "_mix_source")
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "mix_copy", "mix_key"]
    counts = {r._mix_source: r["count"] for r in got.where("doc_id is null and source = 's'").groupBy("_mix_source").count().collect()}
    assert 200 < len(counts) < 310 and 330 < sum(counts.values()) < 480 and len(set(counts.values())) > 2
    assert got.where("doc_id = 7").count() % 2 == 0
    keys = [r.mix_key for r in got.select("mix_key").collect()]
    assert keys == sorted(keys)
    again = mixing.mix(got, seed=5)
    assert again.columns == [*docs.columns, "mix_copy", "mix_key"]


def test_mixing_equals_sql_with_large_rates_and_null_ids(spark, tmp_path):
    import duckdb

    from cuesheet.llm import oracles

    rows = [(None if i % 50 == 0 else i, f"t{i}", "en", "few" if i < 6 else None if i % 3 else "many", 2) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(oracles.mixing_sql(f"read_parquet('{tmp_path}/d/*.parquet')", power=0.0)).fetchall()
    got = [tuple(r) for r in mixing.mix(docs, power=0.0).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 3000


def test_one_member_a_record_can_be_sought(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i % 3}", "<p>" + "é" * (i % 5) * 50_000 + f"{i % 40}</p>") for i in range(120)] + [(3, "http://h.org", "again"), (3, "http://h.org", "again")], "page_id long, url string, html string")
    index = [r for r in warc.archive(pages, path=str(tmp_path / "w")).collect()]
    assert len(index) == 122
    for r in index:
        raw = (tmp_path / "w" / r.archive).read_bytes()
        record = gzip.decompress(raw[r.offset : r.offset + r.length]).decode()
        assert record.startswith("WARC/1.1\r\n") and f"<{warc.PAGE}{r.page_id}>" in record and r.payload_digest in record
        assert r.record_type == "revisit" or record.endswith("</p>") or record.endswith("again")
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == 122
    order = [(r.urlkey, r.ts, r.page_id) for r in index]
    assert order == sorted(order)


def test_warc_joins_revisits_either_way(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"x{i % 9}") for i in range(60)] + [(None, "u", "x1"), (None, "u", "y"), (None, "u", "y")], "page_id long, url string, html string").withColumn("digest", queries.F.lit(1)).withColumn("revisit", queries.F.lit("z"))
    wide = sorted(warc.archive(pages).select("page_id", "record_type", "refers_to").collect(), key=str)
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    assert sorted(warc.archive(pages).select("page_id", "record_type", "refers_to").collect(), key=str) == wide
    assert [(r.record_type, r.refers_to) for r in wide if r.page_id is None] == [("response", None), ("response", None), ("revisit", 1)]


def test_quality_features_and_updates_are_plain_ones(spark):
    texts = ["One two two three", "ALL CAPS!! ALL", "", None, "a b a b a b", "é è, é è"]
    offsets, at, values = quality.features(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        parts = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (text or "").encode())
        grams = [*parts, *[("again",) if a == b else (a, b) for a, b in zip(parts, parts[1:], strict=False)], *["caps" for p in parts if len(p) > 2 and re.fullmatch(rb"[A-Z]+", p)]]
        counts = {g: grams.count(g) for g in grams}
        want = sorted((c / len(grams)) ** 0.5 for c in counts.values())
        assert np.allclose(sorted(values[offsets[i] : offsets[i + 1]]), want)
    labels = np.array([1, 0, 1, 0, 1, 0])
    w = quality.ftrl([(offsets, at, values)], [labels], updates=30, l1=0.02)
    z, n, bias = {}, {}, 1 << quality.BITS
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= 0.02 else -(z[k] - np.sign(z[k]) * 0.02) / ((1 + n[k] ** 0.5) / 1.0 + 0.01)
    for _ in range(5):
        for i, y in enumerate(labels):
            x = {int(k): float(v) for k, v in zip(at[offsets[i] : offsets[i + 1]], values[offsets[i] : offsets[i + 1]], strict=True)} | {bias: 1.0}
            now = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(now[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) * now[k]
                n[k] = n.get(k, 0.0) + g * g
    assert all(abs(w[k] - weight(k)) < 1e-5 for k in z) and np.count_nonzero(w) <= len(z)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(rows, w).collect()}
    for i in range(len(texts)):
        total = w[bias] + sum(w[k] * v for k, v in zip(at[offsets[i] : offsets[i + 1]], values[offsets[i] : offsets[i + 1]], strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-6


def test_neighbours_of_clusters_doubles_and_ties(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 24)) * 3
    x = np.repeat(centers, 60, axis=0) + rng.normal(size=(1800, 24)) * 0.4
    x[40:46] = x[40]
    x[0] *= 1 + 1e-12
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, queries.F.col("vec_id") % 60 == 0, k=12).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for i in range(0, 1800, 60):
        mine = got[got.query_id == i]
        scores = np.zeros(1800)
        for k in range(24):
            scores += x[i, k] * x[:, k]
        assert np.array_equal(mine.score.to_numpy(), scores[mine.vec_id]) and list(mine["rank"]) == list(range(1, 13)) and i not in set(mine.vec_id)
        assert [*zip(-mine.score, mine.vec_id)] == sorted(zip(-mine.score, mine.vec_id))
        scores[i] = -np.inf
        hits += len(set(mine.vec_id) & set(np.lexsort((np.arange(1800), -scores))[:12].tolist()))
    assert hits / 360 >= 0.9


def test_licenses_odd_rows(spark):
    known = {"A": "Same words here.", "B#2": "same words, here", "C": "per cent of the copyright holders"}
    long = "x " * 40_000 + "\nSame words here!\n" + "y " * 40_000
    rows = [(1, "SAME WORDS HERE"), (1, "SAME WORDS HERE"), (2, long), (None, ""), (3, None), (4, "percent of\nthe copyright owners"), (5, "(c) 2020 me\nSame words\r here\n\nSame words here")]
    docs = documents(spark, rows).withColumn("digest", queries.F.lit("z")).withColumn("_hits", queries.F.lit(1))
    got = sorted(licenses.scan(docs, known=known, digests={}).drop("text_digest").collect(), key=str)
    want = [(1, "A", "A", 1), (1, "A", "A", 1), (2, None, "A", 1), (None, None, "", 0), (3, None, "", 0), (4, "C", "", 0), (5, None, "A", 2)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(doc_id={r[0]!r}, text_license={r[1]!r}")
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-2"), reason="no licence files here")
def test_whole_published_licences(spark):
    with open("/usr/share/common-licenses/GPL-2") as file:
        text = file.read()
    got = licenses.scan(documents(spark, [(1, text), (2, "  " + text.upper() + "\n"), (3, text + "more")])).orderBy("doc_id").collect()
    assert [r.text_license for r in got] == ["GPL-2.0", "GPL-2.0", None]


def plain_fingerprint(text):
    """Signatures as tuples: an anchor and the next two content words of the text."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    anchors = {a.encode() for a in spotsigs.ANCHORS}
    made = set()
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if x not in anchors][:2]
        if w in anchors and len(rest) == 2:
            made.add((w, *rest))
    return made or ({("all", *words)} if words else {("text", text)} if text else set())


def test_spotsigs_are_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = spotsigs.edit_test(docs).orderBy("doc_id").collect()
    read = lambda x: np.frombuffer(base64.b64decode(x), ">u4").tolist()
    hashed = {}
    for n, (t, r) in enumerate(zip(texts, got, strict=True)):
        after = texts[(n + 1) % len(texts)] or ""
        edited = (t or "")[: len(t or "") - len(t or "") // 2] + after[: len(t or "") // 2]
        own, other, cut = plain_fingerprint(t), plain_fingerprint(after), plain_fingerprint(edited)
        for want, printed in ((own, read(r.fingerprint)), (cut, read(r.edited_fingerprint))):
            assert len(printed) == len(want) and printed == sorted(set(printed))
            hashed.setdefault(frozenset(want), tuple(printed))
            assert hashed[frozenset(want)] == tuple(printed)
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_next - jaccard(own, other)) < 1e-12 and abs(r.near_edited - jaccard(own, cut)) < 1e-12
    assert len(set(hashed.values())) == len(hashed)


def test_spotsigs_odd_rows(spark):
    rows = [(None, "the old house stood"), (3, "the old house stood"), (3, "the old house stood"), (1, None), (2, ""), (9, "x" * 60_000 + " the old house")]
    docs = documents(spark, rows).withColumn("class", queries.F.lit(1)).withColumn("part", queries.F.lit("z"))
    got = sorted(spotsigs.edit_test(docs, classes=True).select("doc_id", "n_chars", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 0, 1), (2, 0, 2), (3, 19, 3), (3, 19, 3), (9, 60_014, 3), (None, 19, None)]
    assert spotsigs.edit_test(docs.limit(0)).count() == 0


CLASH = {"id": 1, "label": 2, "text_digest": 3, "score": 4, "ids": 5, "row": 6, "bits": 7, "loss": 8, "marked": 9, "turns": 10, "doc": 11, "key": 12}


def with_clashes(df):
    for name, value in CLASH.items():
        df = df if name in df.columns else df.withColumn(name, queries.F.lit(value))
    return df


def test_text_operators_on_odd_tables(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, clashing columns, and no rows at all: one row out for each row in."""
    long = "word " * 60_000
    docs = with_clashes(documents(spark, [(1, "some words here"), (1, "some words here"), (None, "some words here"), (2, None), (3, ""), (4, long), (5, long + "end")]))
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int"))
    operators = {
        "pieces": lambda d: pieces.encode(d, queries.PIECE_MODEL, verify=True),
        "quality": lambda d: quality.classify(d, with_clashes(labels)),
        "toxicity": lambda d: toxicity.classify(d, with_clashes(labels)),
        "licenses": licenses.scan,
        "spotsigs": spotsigs.edit_test,
        "minhash": minhash.near_components,
    }
    for name, operator in operators.items():
        got = operator(docs).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "None", "2", "3", "4", "5"]), name
        same = [r.fingerprint if name == "spotsigs" else tuple(r)[1:] for r in got if r.doc_id == 1]
        assert len({str(r) for r in same}) == 1, name
        assert operator(docs.limit(0)).count() == 0, name
    encoded = {r.doc_id: r for r in operators["pieces"](docs).collect()}
    assert all(r.parity and r.round_trip for r in encoded.values()) and encoded[4].n_tokens > 50_000 and encoded[2].n_tokens == encoded[3].n_tokens == 0
    assert pieces.decode(pieces.encode(docs.limit(0), queries.PIECE_MODEL), queries.PIECE_MODEL).count() == 0
    scores = [r.score for name in ("quality", "toxicity") for r in operators[name](docs).collect()]
    assert all(0 <= x <= 1 for x in scores)


def test_chat_on_odd_tables(spark):
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 200_000), (1, 2, "assistant", None), (2, None, None, None), (None, 1, "assistant", "a"), (None, 0, "user", "</s>")]
    rows = with_clashes(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    made = chat.examples(rows)
    got = sorted(((r.conv_id or -1, r.example, r.loss_chars) for r in made.collect()))
    assert got == [(-1, 1, 1), (1, 1, 200_000), (1, 2, 0), (2, 1, 0)]
    whole = {r.conv_id: r.t for r in made.where("conv_id is null or example = (case when conv_id = 1 then 2 else 1 end)").select("conv_id", chat.read_turns(queries.F.col("formatted")).alias("t")).collect()}
    assert [(t.role, t.text) for t in whole[1]] == [("user", "hi"), ("user", "hi"), ("assistant", "x" * 200_000), ("assistant", "")]
    assert [t.text for t in whole[None]] == ["</s>", "a"] and chat.examples(rows.limit(0)).count() == 0


def test_neighbours_of_odd_tables(spark):
    rows = [(i, [1.0, 0.0, float(i % 3)]) for i in range(40)] + [(3, [1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [float("inf"), 1.0, 1.0]), (54, [1.0])]
    vectors = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = ann.search(vectors, queries.F.col("vec_id") % 20 == 0, k=5).collect()
    best = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20]
    assert best == [(2, 5.0), (5, 5.0), (8, 5.0), (11, 5.0), (14, 5.0)]
    assert {r.query_id for r in got} == {0, 20}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(oracles.ORACLES[name])
    columns = sorted(want.columns)
    rows = lambda found: sorted(str(tuple(r)) for r in found)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert rows(got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def unigram_model(rule):
    """A unigram model of real size: the BPE model's pieces, scored by their place, with byte fallback and a normaliser of the library's."""
    from sentencepiece import SentencePieceNormalizer

    base = pieces.parse(open(queries.PIECE_MODEL, "rb").read())
    scored = [(t, 0.0 if k != pieces.NORMAL else -float(np.log(i + 10)) - 0.3 * (i % 7), k) for i, (t, _, k) in enumerate(base.pieces)]
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    part = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    made = b"".join(part(1, part(1, t.encode()) + varint(2 << 3 | 5) + np.float32(s).tobytes() + varint(3 << 3) + varint(k)) for t, s, k in scored)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normalizer = next(v for n, v in pieces.message(SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == pieces.NORMALIZER)
    return made + part(2, trainer) + part(3, normalizer)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc"])
def test_unigram_models_of_real_size_have_parity(spark, tmp_path, rule):
    model = unigram_model(rule)
    (tmp_path / "u.model").write_bytes(model)
    read = pieces.parse(model)
    assert read.kind == pieces.UNIGRAM and read.byte_fallback and len(read.pieces) == 32_000 and bool(read.charsmap) == (rule != "identity")
    odd = [(10**6, "ﬁne ＡＢＣ ①②  x\u3000y"), (10**6 + 1, "日本語 🙂 ÿ\u0301 \u200b"), (10**6 + 2, "  lead and trail  "), (10**6 + 3, "aaaa " * 3000), (10**6 + 4, "</s><unk><0x41>")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    found = pieces.encode(docs, str(tmp_path / "u.model"), verify=True)
    from sentencepiece import SentencePieceProcessor

    # the library sums scores in single precision, so in long texts, and between equal scores, it may cut a text otherwise, never better than that
    other = SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    wrong = found.where("parity is null or not parity").collect()
    assert len(wrong) <= 0.05 * len(texts)
    for r in wrong:
        ids = other.encode(texts[r.doc_id])
        mine, its = (sum(read.pieces[i][1] for i in x) for x in (r.ids, ids))
        assert r.parity is False and other.decode(ids) == other.decode(list(r.ids)) and abs(mine - its) <= 2 * np.spacing(np.float32(abs(its)))
    decoded = {r.doc_id: (r.text, r.round_trip) for r in pieces.decode(found, str(tmp_path / "u.model")).collect()}
    assert all(same == (text == texts[i]) for i, (text, same) in decoded.items())
    if rule == "identity":
        lost = {r.doc_id for r in found.where("not round_trip").collect()}
        assert lost <= {r.doc_id for r in docs.collect() if r.text and re.search(r"^ | $|  ", r.text)}


def test_one_item_like_the_pivot_makes_no_others_meet(spark):
    """Sixty items miss the same half of the pivot and aren't linked; one differs from it in a word only."""
    pivot = list(range(100))
    far = [(1, i, 45, 100, [1000 + 10 * i + k for k in range(5)], pivot[:60], i, 500) for i in range(60)]
    like = [(1, 500, 100, 100, [9000], [99], 500, 500), (1, 501, 100, 100, [9001, 9000], [98, 99], 501, 500)]
    rows = spark.createDataFrame(far + like, "key long, id long, size int, pivot_size int, added array<long>, missing array<long>, part long, main long")
    pairing = minhash.ShinglePairing(None, None, 3, 85, 0)
    assert _meetings(rows, pairing).count() < 100
    assert [tuple(r) for r in _met(rows, pairing).collect()] == [(500, 501)]


def test_toxicity_has_a_pair_level(spark):
    """Both classes say the same words, only pairs tell; copies don't raise their continuation counts."""
    said = lambda i, y: f"a{i} mild {'fog' if y else 'sun'} b{i} warm {'sun' if y else 'fog'}"
    both = spark.createDataFrame([(said(i, y), y, i % 3) for i in range(150) for y in (0, 1)], "text string, label int, fold int")
    copies = spark.createDataFrame([("same grave stone", 1, i % 3) for i in range(60)], "text string, label int, fold int")
    model = toxicity.model_of(toxicity.count(both.union(copies)), 0)
    assert model.pairs.count() > 0
    asked = spark.createDataFrame([(0, 0, "x mild fog"), (1, 0, "x mild sun"), (2, 0, "x grave stone"), (3, 0, "x stone grave")], "id long, label int, text string")
    by_limit = [{r.id: r.ratio for r in toxicity.featured(asked, model, broadcast_entries=limit).collect()} for limit in (10**6, 0)]
    assert by_limit[0] == by_limit[1] and by_limit[0][0] > by_limit[0][1] and by_limit[0][2] == by_limit[0][3]


def test_only_items_outside_the_main_part_have_a_prefix_for_each_band(spark):
    """The others' elements say how far they reach, instead of being repeated for each band."""
    rows = spark.createDataFrame([(1, i, 9, 9, [i, 7], [3], i, 1) for i in range(9)], "key long, id long, size int, pivot_size int, added array<long>, missing array<long>, part long, main long")
    plan = _meetings(rows, minhash.ShinglePairing(None, None, 3, 85, 0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(cuts") == 1


def test_triples_move_as_two_numbers():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c a b c", "a"]), pa.array([3, 0])], ["text", "cell"])
    made = pa.Table.from_batches(list(toxicity._triples([batch]))).to_pydict()
    assert set(made) == {"a", "rest"} and sorted(r & 255 for r in made["rest"]) == [8, 8, 8, 8, 9]  # a text of one word has the first one's first triple


def test_components_are_made_anew_only_for_further_links(spark, monkeypatch):
    calls, original = [], linking.connected
    monkeypatch.setattr(linking, "connected", lambda edges: calls.append(1) or original(edges))
    same = " ".join(f"w{k}" for k in range(200))
    rows = [(1, same), (2, same + " x"), (3, same + " y"), (9, "something else altogether here")]
    got = {r.doc_id: r.component_id for r in minhash.near_components(documents(spark, rows), shingle=3, percent=85).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9} and len(calls) == 1
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)], "id long, component long")
    more = spark.createDataFrame([(3, 8), (20, 21)], "a long, b long")
    assert {tuple(r) for r in linking._joined(parts, more).collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (20, 20), (21, 20)}
