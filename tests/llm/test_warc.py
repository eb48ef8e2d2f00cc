import base64
import hashlib
from collections import Counter

from casegate.llm import warc

NESTED = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
ROWS = [
    (1, "http://a/", "same"),
    (2, "http://b/\r\nX-Evil: 1", "same"),
    (3, None, NESTED + NESTED),  # payloads that look like records
    (4, "http://c/", ""),
    (5, "http://c/", None),
    (6, "http://d/", "été\r\n\r\nWARC/1.1\r\n" + "x" * 200_000),
    (7, "http://e/", "tail"),
    (7, "http://e/", "tail"),
    (None, "http://f/", "same"),
    (None, None, "nameless"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, size int, digest string")
    got = warc.round_trip(pages).collect()
    tops = {}
    for i, _, html in ROWS:
        if i is not None:
            tops[html or ""] = max(i, tops.get(html or "", -1))
    want = Counter()
    for i, _, html in ROWS:
        body = (html or "").encode()
        top = tops.get(html or "")
        revisit = top is not None and i != top
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[i, len(body), digest, "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["intact"] for r in got)


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_candidates_hold_more_than_the_chain(spark):
    record = lambda body: f"WARC/1.1\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    content = record("a") + record(record("inner").decode() + record("more").decode()) + record("z")
    found = list(warc.candidates_of(content))
    links = spark.createDataFrame([(1, c["start"], c["following"]) for c in found], "archive long, start long, following long")
    kept = sorted(r["start"] for r in warc.reachable(links).collect())
    assert len(found) > 3 and kept == [0, len(record("a")), len(content) - len(record("z"))]


def test_urls_of_any_length(spark):
    urls = ["http://a/", "data:text/html," + "y" * 150_000, "http://b/", "http://c/" + "z" * 120_000 + "WARC/1.1", "http://d/"]
    rows = [(i, url, f"page {i}") for i, url in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.round_trip(pages).collect()
    assert len({r["archive"] for r in got}) == 1
    assert sorted((r["page_id"], r["url"], r["payload_bytes"]) for r in got) == [(i, url, len(html)) for i, url, html in rows]
    assert all(r["intact"] for r in got)


def test_magic_without_blank_lines_is_read_once():
    body = "x WARC/1.1\r\n" * 50_000
    content = f"WARC/1.1\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    assert [c["start"] for c in warc.candidates_of(content)] == [0]


def test_a_payload_is_hashed_once_per_row(spark):
    pages = spark.createDataFrame([r[:3] for r in ROWS], "page_id long, url string, html string")
    plan = warc.records(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 2  # once below the grouping, once below the join


def test_pages_are_not_shuffled_for_few_repeated_payloads(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([r[:3] for r in ROWS], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages")
    pages, plans, records = spark.read.parquet(f"{tmp_path}/pages"), [], warc.records

    def noted(*args):
        plans.append(records(*args)._jdf.queryExecution().executedPlan().toString())
        return records(*args)

    monkeypatch.setattr(warc, "records", noted)
    for limit, shuffled in ((500_000, False), (1, True)):  # three payloads stand in several rows
        monkeypatch.setattr(warc, "broadcast_if_small", lambda df, n=limit: df.hint("broadcast" if df.count() <= n else "merge"))
        warc.write_archives(pages, f"{tmp_path}/{limit}")
        assert ("Exchange hashpartitioning" in plans.pop()) == shuffled
    kinds = [Counter(r["record_type"] for r in warc.read_archives(spark, f"{tmp_path}/{n}").collect()) for n in (500_000, 1)]
    assert kinds[0] == kinds[1] == {"response": 7, "revisit": 3}
