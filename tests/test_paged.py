"""The paged source: tokens, limits, retries, kinds of errors, and the channel resolution, against plain Python."""

import json

import pytest
from pyspark.errors import PySparkException

from cuesheet.sources import landing, paged
from cuesheet.shipping import ship

COLUMNS = "endpoint string, parent string, token string, status int, body string, troubles int"


def page(n_items, following=None, first=0):
    items = [{"contentDetails": {"videoId": f"v{k}" if k % 3 else None}, "snippet": {"title": f"t{k}"}} for k in range(first, first + n_items)]
    return json.dumps({"items": items} | ({"nextPageToken": following} if following else {}))


def refused(reason, message="no"):
    return json.dumps({"error": {"errors": [{"reason": reason}], "message": message}})


def landed(spark, tmp_path, rows, buckets=3):
    ship(spark)
    folder = str(tmp_path / "landed")
    paged.land(spark.createDataFrame(rows, COLUMNS), folder, buckets)
    return folder


def asking(answers):
    """ask(token) of a script: (status, body), or Trouble for None; and the tokens asked for."""
    asked, script = [], {token: list(xs) for token, xs in answers.items()}

    def ask(token):
        asked.append(token)
        found = script[token].pop(0)
        if found is None:
            raise paged.Trouble("timed out")
        return found

    return ask, asked


def test_pages_follow_tokens_and_stop_at_the_limit():
    answers = {None: [(200, page(4, "b"))], "b": [(200, page(4, "c", 4))], "c": [(200, page(4, None, 8))]}
    ask, asked = asking(answers)
    found = list(paged.pages(ask, "commentThreads"))
    assert [(n, t, len(a["items"]), k) for n, t, a, k in found] == [(0, None, 4, 1), (1, "b", 4, 1), (2, "c", 4, 1)]
    ask, asked = asking(answers)
    found = list(paged.pages(ask, "commentThreads", most=6))
    assert asked == [None, "b"] and [len(a["items"]) for *_, a, _ in found] == [4, 2]
    ask, asked = asking(answers)
    found = list(paged.pages(ask, "playlistItems", most=4))  # items 0, 3, 6 have no video
    assert asked == [None, "b"] and [i["snippet"]["title"] for *_, a, _ in found for i in a["items"]] == ["t0", "t1", "t2", "t3", "t4", "t5"]
    assert list(paged.pages(asking(answers)[0], "commentThreads", most=0)) == []


def test_waits_grow_and_attempts_end():
    waits = []
    ask, asked = asking({None: [None, None, None, None, (200, page(1))]})
    assert [k for *_, k in paged.pages(ask, "x", wait=waits.append)] == [5] and waits == [1, 2, 4, 8]
    waits.clear()
    ask, _ = asking({None: [None] * 7})
    with pytest.raises(paged.Trouble, match="7 attempts"):
        list(paged.pages(ask, "x", attempts=7, wait=waits.append))
    assert waits == [1, 2, 4, 8, 10, 10]


@pytest.mark.parametrize(
    ("status", "body", "kind"),
    [
        (403, refused("commentsDisabled"), paged.SwitchedOff), (403, refused("disabledComments"), paged.SwitchedOff), (403, refused("quotaExceeded"), paged.QuotaSpent),
        (429, refused("dailyLimitExceeded"), paged.QuotaSpent), (404, "not json", paged.Missing), (404, "[]", paged.Missing), (500, "", paged.ApiError),
        (400, json.dumps({"error": {"status": "INVALID", "message": "m"}}), paged.ApiError), (200, "{}", type(None)),
    ],
)
def test_answers_are_classified(status, body, kind):
    assert type(paged.classified(status, body)) is kind


def test_errors_are_not_asked_again():
    ask, asked = asking({None: [(403, refused("quotaExceeded")), (200, page(1))]})
    with pytest.raises(paged.QuotaSpent):
        list(paged.pages(ask, "x"))
    assert asked == [None]


ROWS = [
    ("x", "a", None, 200, page(2, "p1"), 0), ("x", "a", "p1", 200, page(1, None, 2), 2), ("x", "b", None, 403, refused("commentsDisabled"), 0),
    ("x", "c", None, 200, page(2, "p1"), 1), ("x", "c", "p1", 403, refused("disabledComments"), 0), ("x", "ü", None, 200, "{}", 0), ("y", "d", None, 200, page(1), 0),
]


def test_reading_skips_what_is_switched_off_and_asks_again(spark, tmp_path):
    folder = landed(spark, tmp_path, ROWS)
    got = {(r.parent, r.page_no, r.token, r.outcome, r.attempts) for r in paged.read(spark, folder, "x", pace=0).collect()}
    assert got == {("a", 0, None, "page", 1), ("a", 1, "p1", "page", 3), ("b", 0, None, "disabled", 1), ("c", 0, None, "page", 2), ("c", 0, None, "disabled", 1), ("ü", 0, None, "page", 1)}
    assert paged.read(spark, folder, "none").count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    folder = landed(spark, tmp_path, [*ROWS, ("x", "q", None, 403, refused("quotaExceeded"), 0)])
    rows = paged.read(spark, folder, "x", pace=0)
    assert [r.page_no for r in rows.where("parent = 'a'").orderBy("page_no").collect()] == [0, 1]  # q would fail
    assert {r.parent for r in rows.where("parent in ('a', 'c') and page_no = 0").collect()} == {"a", "c"}
    assert rows.where("parent = 'a' and parent = 'c'").count() == 0
    with pytest.raises(PySparkException, match="QuotaSpent"):
        rows.count()
    rows = paged.read(spark, landed(spark, tmp_path / "fine", ROWS), "x", pace=0)
    counted = [rows.count(), rows.where("parent = 'a'").count(), rows.count(), rows.where("parent = 'c'").count(), rows.where("outcome = 'page'").count(), rows.count()]
    assert counted == [6, 2, 6, 2, 4, 6]  # what was pushed before doesn't stay


def test_missing_parents_and_lasting_trouble(spark, tmp_path):
    folder = landed(spark, tmp_path, [("x", "a", None, 404, "gone", 0), ("x", "b", None, 200, page(1, "lost"), 0), ("z", "t", None, 200, "{}", 9)])
    with pytest.raises(PySparkException, match="Missing"):
        paged.read(spark, folder, "x").count()
    got = {(r.parent, r.page_no, r.outcome) for r in paged.read(spark, folder, "x", missing="skip").collect()}
    assert got == {("a", 0, "missing"), ("b", 0, "page"), ("b", 0, "missing")}
    with pytest.raises(PySparkException, match="no answer after 3 attempts"):
        paged.read(spark, folder, "z", pace=0, attempts=3).count()


def test_a_bucket_is_read_without_looking_at_others(spark, tmp_path, monkeypatch):
    pages = [("y", "d", f"p{k}" if k else None, 200, page(1, f"p{k + 1}" if k < 12 else None, k), 0) for k in range(13)]
    folder = landed(spark, tmp_path, [*[r for r in ROWS if r[0] == "x"], *pages], buckets=7)
    seen, original = [], paged.ds.dataset
    monkeypatch.setattr(paged.ds, "dataset", lambda place, **kw: seen.append(place) or original(place, **kw))
    reader = paged.PagedSource({"folder": folder, "endpoint": "y"}).reader(None)
    (only,) = reader.partitions()
    assert [(r[0], r[1]) for r in reader.read(only)] == [("d", k) for k in range(13)]
    assert seen and all("/endpoint=y/bucket=" in place for place in seen)
    transport = reader.source.transport()
    for parent in transport.parents("y", only.value, None):
        for token in (None, "p1", "p2"):
            assert transport.get("y", parent, token)[0] == 200 and not transport.passed  # pages come in their order: none is held
        assert transport.get("y", parent, "p12")[0] == 200 and len(transport.passed) == 9


def test_no_responses_at_all(spark, tmp_path):
    folder = landed(spark, tmp_path, [])
    assert paged.read(spark, folder, "x").count() == 0


def test_channels_are_resolved_in_order(spark):
    """Ids, handles with and without @, URLs through their pages; against the rules written out."""
    ship(spark)
    known = {("id", "UC1"): "one", ("handle", "@two"): "two", ("handle", "three"): "three", ("handle", "@three"): "other", ("id", "UC9"): None, ("handle", "last"): None, ("handle", "@last"): "last"}
    payload = lambda name: json.dumps({"items": [{"id": f"UC{name}", "snippet": {"title": name}, "contentDetails": {"relatedPlaylists": {"uploads": f"UU{name}"}}}]}) if name else '{"items": [{"id": "UCx"}]}'
    answers = spark.createDataFrame([(kind, key, payload(name)) for (kind, key), name in known.items()] + [("handle", "empty", '{"items": []}'), ("handle", "bad", "no json")], "kind string, key string, payload string")
    site = "https://www.youtube.com/"
    pages = spark.createDataFrame([(f"{site}c/shop", '"channelId":"UC1"'), (f"{site}@two", "no id here"), (f"{site}c/gone", '"browseId":"UC9"'), (f"{site}channel/UC1", '"channelId":"UC9"')], "url string, html string")
    inputs = ["UC1", " UC1 ", "two", "@two", "three", "@three", "last", "empty", "bad", "nobody", "UC9", f"{site}c/shop", f"{site}@two", f"{site}c/gone", f"{site}channel/UC1", f"{site}user/three?x=1", "", None]
    got = {r.channel: (r.channel_title, r.asked) for r in landing.resolved(spark.createDataFrame([(i,) for i in inputs], "channel string"), pages, answers).collect()}
    want = {
        "UC1": ("one", "id UC1"), " UC1 ": ("one", "id UC1"), "two": ("two", "handle @two"), "@two": ("two", "handle @two"), "three": ("three", "handle three"), "@three": ("other", "handle @three"),
        "last": ("last", "handle @last"), "empty": (None, None), "bad": (None, None), "nobody": (None, None), "UC9": (None, None), f"{site}c/shop": ("one", "id UC1"), f"{site}@two": ("two", "handle @two"),
        f"{site}c/gone": (None, None), f"{site}channel/UC1": ("one", "id UC1"), f"{site}user/three?x=1": ("three", "handle three"), "": (None, None),
    }
    assert {k: v for k, v in got.items() if k is not None} == want
