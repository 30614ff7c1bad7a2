import hashlib

from stratagrid.llm import warc
from stratagrid.session import table


def brute(rows):
    body = [(r.page_id, (r.html or "").encode()) for r in rows]
    first = {}
    for i, b in body:
        if i is not None and (b not in first or i < first[b]):
            first[b] = i
    out = []
    for i, b in body:
        again = len(b) >= 100 and i != first.get(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first.get(b) if again else None))
    return sorted(out, key=str)


def check(spark, pages, path):
    warc.write_archive(pages, path)
    got = [tuple(r)[:5] for r in warc.described(warc.read_archive(spark, path)).collect()]
    assert sorted(got, key=str) == brute(pages.select("page_id", "html").collect())
    digests = [r.digest for r in spark.read.parquet(f"{path}/payloads").select("digest").collect()]
    assert len(digests) == len(set(digests))


def test_round_trip(spark, sf, tmp_path):
    check(spark, table(spark, sf, "pages"), str(tmp_path / "a"))


def test_odd_rows(spark, tmp_path):
    long = "<p>same page</p>" * 10
    rows = [(1, None, None), (2, "u", ""), (3, "u\r\nX: y", long), (3, "u", long), (4, None, long), (None, "u", long), (5, "u", "é" * 60), (6, "u", "é" * 60), (7, "u", "short"), (8, "u", "short"), (9, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    check(spark, pages, str(tmp_path / "b"))
    check(spark, pages.limit(0), str(tmp_path / "c"))


def test_records_are_whole(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>hi</p>")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "d"))
    record = bytes(warc.read_archive(spark, str(tmp_path / "d")).first().record)
    head, body = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 9" in head and body == b"<p>hi</p>\r\n\r\n"


def test_breaks_in_a_url_start_no_field(spark, tmp_path):
    urls = [f"http://a/{c}WARC-Refers-To: 7" for c in ("\u2028", "\u2029", "\x85", "\x0b", "\x0c", "\r\n", "\n", "\r")]
    pages = spark.createDataFrame([(i, u, f"page {i} " * 30) for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.described(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    assert len(got) == len(urls) and all(r.record_type == "response" and r.refers_to is None for r in got)


def test_headers_have_what_the_standard_asks_for(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/", "same " * 30) for i in (1, 2)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "e"), "2024-05-06T07:08:09Z")
    heads = {r.page_id: r.header.split("\r\n") for r in warc.read_archive(spark, str(tmp_path / "e")).collect()}
    for i, lines in heads.items():
        names = [x.split(": ")[0] for x in lines[1:-2]]
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""] and len(set(names)) == len(names)
        assert {"WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"} <= set(names) and "WARC-Date: 2024-05-06T07:08:09Z" in lines
        assert ("WARC-Profile" in names) == ("WARC-Refers-To" in names) == (i == 2)
