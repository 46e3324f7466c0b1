"""WARC archives and their globally ordered capture index.

Pages are written as WARC 1.1 records, each a gzip member of its own, so that the index's
offsets can be sought in the archives: of equal payloads the page with the smallest id
becomes a response, the others revisit records that point to it. Each archive read back
gives a run of captures sorted by URL key and timestamp; the runs are merged by ranges
of that key, each range in one task with a loser tree over its part of all runs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.scratch import delete, drop, keep, new_path

# The base32 alphabet, the record separator, the revisit profile.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:cuesheet:page:"
RECORDS_PER_ARCHIVE, BYTES_PER_ARCHIVE = 2000, 64 << 20
BROADCAST_REVISITS = 200_000
CHUNK = 1 << 16
ROWS_PER_MERGE = 50_000
CAPTURE = "urlkey string, ts string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"


def sha1_base32(data: Column) -> Column:
    """The SHA-1 of binary data in upper-case base32, from five hex digits (four letters) at a time."""
    hexed, out = F.sha1(data), []
    for i in range(8):
        bits = F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def capture_time(page_id: Column) -> Column:
    """A time in place of the crawl's, which pages lack: page_id seconds (modulo 10**9) after the start of 2020, in UTC."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.pmod(F.floor(second / 3600), F.lit(24))), two(F.pmod(F.floor(second / 60), F.lit(60))), two(F.pmod(second, F.lit(60))))
    return F.concat(F.date_add(F.lit("2020-01-01").cast("date"), F.floor(second / 86400).cast("int")).cast("string"), F.lit("T"), clock, F.lit("Z"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(record): the text of a WARC record for each page, without the separator after it.

    Null payloads are empty. Of equal payloads of min_revisit_bytes or more, rows with the
    smallest page_id are responses and the others revisits; null ids count as larger than
    all, and a payload that only has null ids has responses only. Line ends in URLs
    are percent-encoded; a null URL is left out.

    Which rows revisit is found from digests alone. Payloads stay where they are if a count
    shows that few rows revisit, and move by page id otherwise, never by digest.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    size = F.octet_length("html")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), sha1_base32(payload).alias("digest"))
    found = keep(rows.select("id", "digest", size.alias("size")), "digests")
    first = found.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    again = found.join(first, "digest").where("id is null or id > first_id").select(F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), "first_id").distinct()
    again = keep(again, "revisits")
    drop(found)
    few = again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    joined = rows.join(F.broadcast(again) if few else again, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    joined = joined.withColumn("revisit", F.col("first_id").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    name = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.concat(F.lit("WARC-Date: "), capture_time(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name("first_id"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    return joined.withColumn("block", block).select(F.concat(F.concat_ws("\r\n", *fields), F.lit(END), "block").alias("record"))


def _members(batches):
    for batch in batches:
        for record in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record.as_py().encode(), 6, mtime=0)], pa.binary())], ["member"])


def write(made: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write records as archives of at most records_per_archive each, through Spark's committing text writer.

    Every record is a gzip member, and so is the separator after it. The writer puts out
    the members' bytes as they are.
    """
    members = made.mapInArrow(_members, "member binary").select(F.col("member").cast("string"))
    separator = gzip.compress(END.encode(), 6, mtime=0).decode("latin-1")
    members.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", records_per_archive).text(path)


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive, one in memory at a time; separators are left out."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        reader, content, stop = zlib.decompressobj(wbits=31), [], at
        while not reader.eof:
            if stop >= len(raw):
                raise ValueError(f"the archive ends in a member that begins at {at}")
            piece = view[stop : stop + CHUNK]
            content.append(reader.decompress(piece))
            stop += len(piece)
        stop -= len(reader.unused_data)
        whole = b"".join(content)
        if whole != END.encode():
            yield at, stop - at, whole
        at = stop


def url_key(url: str) -> str:
    """A sort key: host labels in reverse, then path and query, without scheme, www, port 80/443, fragment or case."""
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url.strip().lower(), re.S)
    if not found:
        return url.strip().lower().partition("#")[0]
    host = re.sub(r":(80|443)?$", "", found[1]).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/")


def parse(raw: bytes, archive: str) -> Iterator[tuple]:
    """Captures of an archive's records, with the offsets and lengths of their members. A payload that doesn't have its stated digest is an error."""
    number = lambda text: None if text in (None, f"<{PAGE}null>") else int(text.removeprefix(f"<{PAGE}").removesuffix(">"))
    for at, length, record in members(raw):
        start = record.index(b"\r\n\r\n") + 4
        lines = record[: start - 4].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {archive}:{at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        http_end = record.index(b"\r\n\r\n", start) + 4
        http = dict(line.split(": ", 1) for line in record[start : http_end - 4].decode().split("\r\n")[1:])
        digest, kind, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(http["Content-Length"])
        if kind == "response":
            payload = record[http_end : start + int(fields["Content-Length"])]
            size = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"wrong payload digest at {archive}:{at}")
        url = fields.get("WARC-Target-URI")
        yield (url_key(url or ""), fields["WARC-Date"], number(fields["WARC-Record-ID"]), url, kind, number(fields.get("WARC-Refers-To")), digest, size, archive, at, length)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [(k.split()[0], pa.int64() if k.split()[1] == "long" else pa.string()) for k in CAPTURE.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _runs(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            archive = unquote(path.rpartition("/")[2])
            yield _batch(sorted(parse(content.as_buffer().to_pybytes(), archive), key=_order))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path; each archive's are a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_runs, CAPTURE)


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so each next row costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list[tuple | None] = [None] * self.k
        self.keys: list[tuple | None] = [None] * self.k
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._advance(i)
        for i in range(self.k):
            self._replay(i)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, i: int, j: int) -> bool:
        """Whether run i's head comes before run j's; ended runs come last."""
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[j] is None and (self.keys[i] is not None or i < j)
        return (self.keys[i], i) < (self.keys[j], j)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (winner := self.losers[0]) >= 0 and self.heads[winner] is not None:
            yield self.heads[winner]
            self._advance(winner)
            self._replay(winner)


def _merge(batches):
    by_run: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            by_run.setdefault(row[8], []).append(row)
    for run in by_run.values():
        if any(_order(a) > _order(b) for a, b in zip(run, run[1:], strict=False)):
            run.sort(key=_order)  # runs arrive in order, but for one whose blocks were fetched again
    rows: list[tuple] = []
    for row in LoserTree([iter(run) for _, run in sorted(by_run.items())], _order):
        rows.append(row)
        if len(rows) == 5000:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order of (urlkey, ts, page_id), nulls first: partitions are ordered ranges, rows ordered inside.

    Ranges have about ROWS_PER_MERGE captures; archive and offset belong to the range key,
    so captures of one URL can be in several ranges.
    """
    ranges = max(1, -(-runs.count() // ROWS_PER_MERGE))
    return runs.repartitionByRange(ranges, "urlkey", "ts", F.col("page_id").asc_nulls_first(), "archive", "offset").mapInArrow(_merge, CAPTURE)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives under path (default: a shared folder, deleted after it has been read), read them back, and merge their index.

    An archive holds RECORDS_PER_ARCHIVE records, or fewer so that the mean one has BYTES_PER_ARCHIVE. A row for each row of pages, with the columns of CAPTURE. Empty tables give no
    archives' records and an empty index; repeated rows give repeated records. Other
    columns are ignored.
    """
    spark = pages.sparkSession
    place = path or new_path(spark, "warc")
    rows, n_bytes = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(html)))).first()
    largest = max(1, min(RECORDS_PER_ARCHIVE, BYTES_PER_ARCHIVE * rows // max(1, n_bytes or 0)))
    write(records(pages, page_id, url, html, min_revisit_bytes), place, largest)
    runs = keep(read_runs(spark, place), "runs")
    if not path:
        delete(spark, place)
    return merge_runs(runs)
