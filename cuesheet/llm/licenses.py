"""Licence scans by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings), the whole form is digested, and the digest is hash-joined
to the digests of known licences. Units are the whole text and, because notices
are usually a line of a larger text, each whole line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, KNOWN

# Equivalent spellings, as whole words of the canonical form.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("organisation", "organization"),
    ("organisations", "organizations"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("per cent", "percent"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("sub license", "sublicense"), ("https", "http"), ("and or", "and/or"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only states a copyright: the word or sign first, or after "portions".
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;]*(portions )?(copyright|\(c\)|©)[^\n]*[0-9][^\n]*"
RESERVED_LINE = r"(^|\n)[ \t*#/;]*all rights reserved[. \t]*"
OTHER_SIGNS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f©“”‘’–—]+"
OTHER_SIGNS_BUT_LINE_ENDS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f©“”‘’–—]+"


def _spelled(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return text


def canonical_lines(text: Column) -> Column:
    """The canonical form of every line, in one string: lines are parted by " \\n ", blanks around them; lines that only state a copyright are empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.replace(out, F.lit("\r"), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), RESERVED_LINE, "\n")
    out = F.regexp_replace(out, OTHER_SIGNS_BUT_LINE_ENDS, " ")
    return _spelled(F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" ")))


def joined(lines: Column) -> Column:
    """The canonical form of the whole text, from canonical_lines(): spellings can go over line ends."""
    return F.trim(_spelled(F.regexp_replace(lines, r"[ \n]+", " ")))


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, words only, one spelling, single spaces; null is empty."""
    return joined(canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark: SparkSession, known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """(license_id, digest, size) of the known texts, and of known digests (size null); of equal forms the smallest id stays. Its size is fixed by both."""
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, license_text string").withColumn("form", canonical(F.col("license_text")))
    rows = rows.select("license_id", F.sha2("form", 256).alias("digest"), F.char_length("form").alias("size"))
    given = spark.createDataFrame([(k, v, None) for k, v in sorted(digests.items())], "license_id string, digest string, size int")
    return rows.union(given).groupBy("digest").agg(F.min(F.split("license_id", "#")[0]).alias("license_id"), F.max("size").alias("size"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """A row for each row of docs: doc_id, text_digest, text_license, line_licenses, n_license_lines.

    text_license: the licence that the whole text is, or null. line_licenses: the
    licences that whole lines are, distinct and sorted, joined by commas ("" without
    any); n_license_lines counts these lines. Null and empty texts match nothing.
    Long texts are digested whole. Repeated rows and null ids give a row each. Other
    columns are ignored, whatever their names. Of licences of one form the smallest id counts.

    Texts are brought to canonical form once, line by line. The registry has one row for
    each known licence, so it is broadcast. Lines stay in their row, without a shuffle:
    those as long as a known form are digested and looked up in a constant map of the registry.
    """
    spark = docs.sparkSession
    found = registry(spark, known, digests)
    listed = found.collect()
    table = F.create_map(*[F.lit(x) for row in listed for x in (row["digest"], row["license_id"])])
    sizes = sorted({row["size"] for row in listed if row["size"] is not None})
    rows = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("_lines"))
    rows = rows.select("doc_id", "_lines", F.sha2(joined(F.col("_lines")), 256).alias("text_digest"))
    whole = rows.join(F.broadcast(found.select(F.col("license_id").alias("text_license"), "digest")), F.col("text_digest") == F.col("digest"), "left")
    lines = F.transform(F.split("_lines", "\n"), lambda line: F.trim(F.regexp_replace(line, " +", " ")))
    fits = F.filter(lines, lambda line: F.char_length(line).isin(*sizes))
    hits = F.filter(F.transform(fits, lambda line: F.try_element_at(table, F.sha2(line, 256))), lambda x: x.isNotNull())
    return whole.withColumn("_hits", hits).select(
        "doc_id", "text_digest", "text_license",
        F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("line_licenses"),
        F.size("_hits").cast("bigint").alias("n_license_lines"),
    )
