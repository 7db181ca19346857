import gzip
import hashlib
import io
from collections import Counter
from pathlib import Path

from fieldloom.llm import warc
from fieldloom.session import new_path

SCHEMA = "page_id long, url string, html string, payload string, shard string"


def brute(rows):
    least = {}
    for page, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            least[html] = min(least.get(html, page), page)
    out = Counter()
    for page, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and page is not None and page > least[html]
        out[(page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[html] if revisit else None)] += 1
    return out


def check(spark, pages):
    want = brute([(r.page_id, r.html) for r in pages.select("page_id", "html").collect()])
    assert Counter(tuple(r) for r in warc.round_trip(spark, pages).collect()) == want


EDGE = [
    (1, "http://a/é b?x=1#f", "x" * 100), (2, None, "x" * 100), (3, "http://a/\r\nEvil: 1", "x" * 99), (4, "", "x" * 99), (5, "http://b/", None), (6, "http://b/", ""),
    (7, "http://c/", "ünïcödé 漢 " * 50), (7, "http://c/", "ünïcödé 漢 " * 50), (None, "http://d/", "x" * 100), (9, "http://e/", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9),
    (10, "http://f/", "long " * 400_000), (11, "http://f/", "long " * 400_000), (0, "http://g/", "x" * 100),
]


def test_round_trip_equals_brute_force(spark, pages):
    check(spark, pages)


def test_edge_cases(spark):
    check(spark, spark.createDataFrame([(*r, "p", "s") for r in EDGE], SCHEMA))


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder.removeprefix("file://")).glob("*.warc.gz")}


def test_files_depend_on_the_rows_alone_and_are_plain_warc(spark, pages):
    a, b = new_path(spark, "warc"), new_path(spark, "warc")
    manifest = warc.write(pages, a, roll=4096, range_bytes=1 << 20).collect()
    warc.write(pages.repartition(5, "url"), b, roll=4096, range_bytes=1 << 20)
    assert files(a) == files(b) and not (Path(a.removeprefix("file://")) / "_temporary").exists()
    names = {m.name.rsplit("/", 1)[1]: m for m in manifest}
    assert set(names) == set(files(a)) and len(names) > 10
    pages_seen = []
    for name in sorted(names):
        raw, m = files(a)[name], names[name]
        assert m.bytes == len(raw) and m.sha256 == hashlib.sha256(raw).hexdigest()
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as stream:
            records = list(warc.records(stream))
        assert records[0][0]["warc-type"] == "warcinfo" and len(records) == m.records + 1
        pages_seen += [int(h["x-page-id"]) for h, _ in records[1:]]
        assert len(raw) <= 4096 + max(len(b) for _, b in records) + 1024
    assert pages_seen == sorted(r.page_id for r in pages.select("page_id").collect())


def test_html_and_urls_come_back(spark, pages):
    folder = new_path(spark, "warc")
    back = {r.page_id: r for r in warc.read(warc.write(pages, folder), folder).collect()}
    for r in pages.collect():
        assert back[r.page_id].url == r.url
        assert back[r.page_id].html == (r.html if back[r.page_id].record_type == "response" else None)


def test_damage_is_found(spark, pages):
    folder = new_path(spark, "warc")
    manifest = warc.write(pages, folder)
    path = Path(manifest.first().name)
    text = gzip.decompress(path.read_bytes()).replace(b"HTTP/1.1 200", b"HTTP/1.1 201", 1)
    path.write_bytes(gzip.compress(text))
    try:
        warc.read(manifest, folder).count()
    except Exception as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError("a changed record was read")


def test_revisits_name_the_record_they_revisit(spark):
    folder = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(*r, "p", "s") for r in EDGE], SCHEMA), folder)
    heads = []
    for raw in files(folder).values():
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as stream:
            heads += [h for h, _ in warc.records(stream)]
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        first = responses[h["warc-refers-to"]]
        assert first["x-page-id"] == h["x-refers-to-page-id"] and first["warc-payload-digest"] == h["warc-payload-digest"]
        assert (first["warc-target-uri"], first["warc-date"]) == (h["warc-refers-to-target-uri"], h["warc-refers-to-date"])
