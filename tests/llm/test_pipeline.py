"""The pipeline's stages against what they have to do with their own input."""

import corpus_pipeline
from cuesheet.llm import minhash, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, ids = docs, [r.doc_id for r in docs.select("doc_id").collect()]
        docs = stage(spark, docs, SF)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= set(ids)
        if name == "quality":
            want = {r.doc_id for r in quality.classify(before, labels).where("predicted = 1").collect()}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.classify(before, labels).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            want = {r.doc_id for r in minhash.near_components(before, shingle=5, percent=80).where("kept").collect()}
        else:
            continue
        assert set(after) == want and docs.columns == corpus_pipeline.COLUMNS
    assert sorted(after) == sorted(ids) and docs.where("not round_trip").count() == 0


def test_rows_with_null_and_shared_ids(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good, bad = (quality.classify(docs, labels, carry=["text"]).where(f"predicted = {k} and length(text) > 200").orderBy("doc_id").first().text for k in (1, 0))
    added = [(None, bad, "en", "s", 1), (9_000_001, bad, "en", "s", 1), (9_000_001, good, "en", "s", 1), (None, good, "en", "s", 1)]
    mixed = docs.union(spark.createDataFrame(added, columns))
    left = [(r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, mixed, SF).where("doc_id is null or doc_id = 9000001").collect()]
    assert sorted(left, key=str) == sorted([(9_000_001, good), (None, good)], key=str)

    toxic = [(i, "grim foul words here and there" if i % 4 == 0 else f"plain clean words number {i} and more", "en", "s", 1) for i in range(400)]
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    bad, good = toxic[0][1], toxic[1][1]
    odd = [(None, bad, "en", "s", 1), (None, good, "en", "s", 1), (500, bad, "en", "s", 1), (500, good, "en", "s", 1)]
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, spark.createDataFrame(toxic + odd, columns), str(tmp_path)).where("doc_id is null or doc_id = 500").collect()]
    assert sorted(left, key=str) == sorted([(500, good), (None, good)], key=str)


def test_one_row_of_each_group_is_kept(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    texts = [(3, a), (3, a), (3, b), (7, a), (None, a), (None, a), (None, b), (None, c), (None, c + " more"), (8, None), (None, None), (None, None), (9, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    ids = [i for i, t in got if t and t.startswith("c0")]
    rest = sorted((x for x in got if not (x[1] or "").startswith("c0")), key=str)
    assert ids == [None] and rest == sorted([(3, a), (3, b), (8, None), (9, "x"), (None, None)], key=str)


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, label int, score double, part string, doc string, row long, mix_key long, _gone long, cdf string"


def test_stages_on_odd_tables(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(6).collect()]
    texts = [*good, good[0], None, "", "  ", "x", (good[1] + " ") * 150]
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", None if i % 4 == 0 else "s", None, i, i, 0.5, "p", "d", i, i, i, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], ODD)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        want = ["doc_id", "ids", "n_tokens", "round_trip"] if name == "tokens" else corpus_pipeline.COLUMNS
        assert after.columns == want, name
        kept = after.count()
        assert kept == 14 if name == "tokens" else kept > 0, name
        if name not in ("tokens", "mixing"):
            assert after.join(docs.select("text").distinct(), after.text.eqNullSafe(docs.text), "left_anti").count() == 0
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert left.where(left.text == good[1]).count() == 1 and left.where("text is null").count() == 1
