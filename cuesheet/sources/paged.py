"""A paged API as a Spark data source: page tokens, retries, classified errors and read limits.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("endpoint", "commentThreads").option("folder", landed).load()

A row is one page of a parent: (parent, page_no, token, payload, outcome, attempts). The
parents are dealt to partitions by their hash, and a partition follows the page tokens of its own.
A filter on parent goes to the reader, which then asks for these parents only; `most` ends a
parent's paging as soon as that many items have come, and cuts the last page.

What goes wrong is of one of these kinds:

* no answer (Trouble): asked again after 1, 2, 4, ... seconds, `attempts` times at most, then the read fails;
* comments are switched off (SwitchedOff): the parent gives one row without payload, outcome `disabled`;
* the quota is spent (QuotaSpent): the read fails, because no other request would be answered;
* no such parent (Missing): the read fails, or with missing=skip gives a row with outcome `missing`;
* any other answer (ApiError): the read fails.

PagedSource reads landed responses. For an API, override transport() by an object with
the methods of Landed.
"""

from __future__ import annotations

import heapq
import itertools
import json
import operator
import time
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "parent string, page_no int, token string, payload string, outcome string, attempts int"
# Reasons in answers.
SWITCHED_OFF = ("commentsDisabled", "disabledComments")
QUOTA_SPENT = ("quotaExceeded", "dailyLimitExceeded")
ATTEMPTS, LONGEST_WAIT = 5, 10
BATCH = 500  # rows of landed responses that are decoded at once


class Trouble(Exception):
    """No answer: worth another attempt."""


class ApiError(RuntimeError):
    """An answer that isn't the one asked for."""


class SwitchedOff(ApiError):
    pass


class QuotaSpent(ApiError):
    pass


class Missing(ApiError):
    pass


def classified(status: int, body: str) -> ApiError | None:
    """The error that an answer is, if it is one."""
    if 200 <= status < 400:
        return None
    try:
        error = json.loads(body).get("error", {})
    except (ValueError, AttributeError):
        error = {}
    listed = error.get("errors") or []
    reason, message = listed[0].get("reason", "") if listed else error.get("status", ""), error.get("message") or body
    if reason in SWITCHED_OFF:
        return SwitchedOff(message)
    if reason in QUOTA_SPENT:
        return QuotaSpent(message)
    return Missing(message) if status == 404 else ApiError(f"{status} {reason}: {message}")


def answered(ask: Callable[[], tuple[int, str]], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> tuple[dict, int]:
    """(answer, attempts that it took). Raises the classified error, or Trouble after the last attempt."""
    for attempt in range(1, attempts + 1):
        try:
            status, body = ask()
        except Trouble as trouble:
            if attempt == attempts:
                raise Trouble(f"no answer after {attempts} attempts: {trouble}") from trouble
            wait(min(2 ** (attempt - 1), LONGEST_WAIT))
            continue
        if error := classified(status, body):
            raise error
        return json.loads(body), attempt
    raise Trouble("no attempt")


def counts(endpoint: str, item: dict) -> bool:
    """Whether an item counts towards a limit: an upload without a video doesn't."""
    return endpoint != "playlistItems" or bool(item.get("contentDetails", {}).get("videoId"))


def pages(ask: Callable[[str | None], tuple[int, str]], endpoint: str, most: int | None = None, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, str | None, dict, int]]:
    """(page number, token, answer, attempts) of one parent's pages, until the last one or until `most` items that count."""
    token, page_no, seen = None, 0, 0
    while most is None or seen < most:
        answer, took = answered(lambda: ask(token), attempts, wait)  # noqa: B023
        items = answer.get("items", [])
        if most is not None:
            for at, item in enumerate(items, 1):
                seen += counts(endpoint, item)
                if seen >= most:
                    answer = answer | {"items": items[:at]}
                    break
        yield page_no, token, answer, took
        token, page_no = answer.get("nextPageToken"), page_no + 1
        if not token:
            return


def bucket_of(parent: str, buckets: int) -> int:
    return zlib.crc32(parent.encode()) % buckets


class Landed:
    """Responses in a folder made by land(). A bucket's files are read once, in order of parents and pages; in memory are those of one parent that were passed by and not asked for yet."""

    def __init__(self, folder: str):
        self.files, self.path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        self.rest: Iterator[dict] = iter(())
        self.passed: dict[str | None, dict] = {}
        self.last, self.asked = None, 0

    def _inside(self, path: str, prefix: str) -> dict[str, str]:
        """The folders in path that are named by prefix and a value, by value. Only path itself is listed."""
        found = self.files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return {unquote(f.base_name.removeprefix(prefix)): f.path for f in found if f.type == pyarrow.fs.FileType.Directory and f.base_name.startswith(prefix)}

    def _parts(self, folder: str) -> list[ds.Fragment]:
        return list(ds.dataset(folder, filesystem=self.files, format="parquet").get_fragments())

    def buckets(self, endpoint: str) -> tuple[int, list[int]]:
        """(number of buckets, those that hold parents of the endpoint)."""
        there = self._inside(self._inside(self.path, "endpoint=").get(endpoint, f"{self.path}/none"), "bucket=")
        if not there:
            return 0, []
        one = next(iter(there.values()))
        return int(self._parts(one)[0].head(1, columns=["buckets"]).column(0)[0].as_py()), sorted(map(int, there))

    def parents(self, endpoint: str, bucket: int, wanted: set[str] | None) -> Iterator[str]:
        """The parents of a bucket in order; get() answers for the one that came last."""
        chosen = None if wanted is None else ds.field("parent").isin(sorted(wanted))
        place = f"{self._inside(self.path, 'endpoint=')[endpoint]}/bucket={bucket}"

        def each(file: ds.Fragment) -> Iterator[dict]:
            for batch in file.to_batches(columns=["parent", "token", "status", "body", "troubles"], filter=chosen, batch_size=BATCH, batch_readahead=1, fragment_readahead=1):
                yield from batch.to_pylist()

        by_parent = operator.itemgetter("parent")
        for parent, rows in itertools.groupby(heapq.merge(*map(each, self._parts(place)), key=by_parent), by_parent):
            self.rest, self.passed, self.last = rows, {}, None
            yield parent

    def get(self, endpoint: str, parent: str, token: str | None) -> tuple[int, str]:
        """(status, body). The first `troubles` requests for a page get no answer."""
        if self.last is None or self.last["token"] != token:
            while token not in self.passed and (row := next(self.rest, None)):
                self.passed[row["token"]] = row
            self.last, self.asked = self.passed.pop(token, None), 0
        if self.last is None:
            return 404, json.dumps({"error": {"message": f"no page {token} of {parent}"}})
        self.asked += 1
        if self.asked <= (self.last["troubles"] or 0):
            raise Trouble("timed out")
        return self.last["status"], self.last["body"]


class PagedReader(DataSourceReader):
    def __init__(self, source: PagedSource):
        self.source, self.options, self.wanted = source, source.options, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("parent",):
                asked = set(f.value if isinstance(f, In) else [f.value])
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self):
        buckets, there = self.source.transport().buckets(self.options["endpoint"])
        needed = None if self.wanted is None or not buckets else {bucket_of(p, buckets) for p in self.wanted if p is not None}
        return [InputPartition(k) for k in there if needed is None or k in needed]

    def read(self, partition):
        if partition is None:  # there are no parents
            return
        endpoint, most = self.options["endpoint"], self.options.get("most")
        attempts, pace = int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("pace", 1))
        transport = self.source.transport()
        for parent in transport.parents(endpoint, partition.value, self.wanted):
            page_no = 0
            try:
                for page_no, token, answer, took in pages(lambda token: transport.get(endpoint, parent, token), endpoint, None if most is None else int(most), attempts, lambda s: time.sleep(s * pace)):  # noqa: B023
                    yield parent, page_no, token, json.dumps(answer, ensure_ascii=False), "page", took
            except SwitchedOff:
                yield parent, page_no, None, None, "disabled", 1
            except Missing:
                if self.options.get("missing", "fail") != "skip":
                    raise
                yield parent, page_no, None, None, "missing", 1


class PagedSource(DataSource):
    """Options: endpoint, folder, most (items a parent), attempts, missing (fail or skip), pace (of waiting; 1: seconds)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def transport(self) -> Landed:
        return Landed(self.options["folder"])

    def reader(self, schema) -> PagedReader:
        return PagedReader(self)


def land(responses: DataFrame, folder: str, buckets: int) -> None:
    """Write responses (endpoint, parent, token, status, body, troubles), dealt by endpoint and parent, for Landed to read: a folder for each endpoint, in it one for each bucket of its parents."""
    bucket = (F.crc32(F.col("parent").cast("binary")) % buckets).cast("int")
    rows = responses.withColumn("bucket", bucket).withColumn("buckets", F.lit(buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("endpoint", "bucket", "parent", F.char_length("token"), "token").write.partitionBy("endpoint", "bucket").parquet(folder)


def read(spark: SparkSession, folder: str, endpoint: str, **options) -> DataFrame:
    """The pages of all parents of an endpoint; filters on parent are pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    pages = spark.read.format("paged").options(folder=folder, endpoint=endpoint, **options).load()
    return pages.where("page_no >= 0")  # true for all: without any filter Spark 4.1 plans with those that were pushed last
