"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bytepairs, chat, licenses, minhash, mixing, pieces, quality, repeats, spotsigs, toxicity, warc

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, verify=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_test(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", folds=3, held=1, threshold=0.7)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), power=0.5, epochs=1.0, seed=17)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, target=0.95)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.examples(turns.unionByName(extra))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    made = made.select("conv_id", "example", "formatted", loss.alias("loss"), F.char_length("formatted").alias("chars"))
    by_conv = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    back = by_conv.withColumn("turns", chat.read_turns(F.col("whole")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=5, held=0, threshold=0.3)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bytepairs.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.collapse(repeats.with_periodic_tails(table(spark, sf_dir, "documents")))
    rows = rows.withColumn("best", repeats.most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = [F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best, exponent, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL)
    return rows.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_sentencepiece, op3_warc, op4_spotsigs, op5_toxicity, op6_mixing, op7_license_scan, op8_ann, op9_chat_formatting,
        op10_quality_classifier, op11_byte_bpe, op12_periodic_runs, op13_token_alignment,
    )
}
