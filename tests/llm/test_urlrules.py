import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from fieldloom.llm import urlrules

WRITTEN = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(raw) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), h + p, v) for v, h, p in WRITTEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.www.example.com/en/y?q=/fr/", "http://notexample.com/en/",
    "http://xcom/", "http://a.net/es/", "http://a.net/fr/x#y", "http://net/es/", "http://a.net/ES/", "http://a.net?x=/es/", "ftp://É.NET/fr/", "http://a.net#/es/", "://net/es/", "http://x://net/fr/", "http://a.net/es\n/",
]


def rows_of(judged):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged.collect())


def test_written_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[7], "x")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    want = Counter((i, h, p, r, v or "allow") for i, u in [*enumerate(URLS), (1, URLS[7])] for h, p, r, v in [brute(u)])
    assert rows_of(urlrules.judge(pages, labels)) == want


def test_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("block"))
    for r in urlrules.judge(pages, labels).join(pages, "page_id").collect():
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))


def test_mined_rules_equal_brute_force(spark):
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, f"http://site{i % 3}.org/{'casino' if bad else 'news'}/{i % 5}.html{'?ref=1' if i % 2 else ''}"))
        if i < 200:
            marks.append((i, bad ^ (i % 40 == 1)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks, "page_id long, block boolean")
    rules = urlrules.mine(pages, labels).collect()
    sets = {r.page_id: (set(r.t), dict(marks)[r.page_id]) for r in pages.select("page_id", urlrules.tokens(F.col("url")).alias("t")).collect() if r.page_id < 200}
    base = sum(b for _, b in sets.values()) / len(sets)
    where, blocked = {}, {i for i, (_, b) in sets.items() if b}
    for i, (t, _) in sets.items():
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                where.setdefault(c, set()).add(i)

    def passes(p):
        n, hits = len(p), len(p & blocked)
        sure = (hits + 1.96**2 / 2 - 1.96 * (hits * (n - hits) / n + 1.96**2 / 4) ** 0.5) / (n + 1.96**2)
        return hits >= 0.002 * 200 and sure >= 0.6 and hits / n / base >= 1.5

    # itemsets of the same pages are one rule: what matters is which sets of pages rules tell
    want = {c for c, p in where.items() if passes(p)}
    got = {frozenset(where[tuple(r.needs)]) for r in rules}
    assert got == {frozenset(where[c]) for c in want} and want
    for r in rules:
        p = where[tuple(r.needs)]
        assert (round(r.confidence, 9), round(r.support, 9)) == (round(len(p & blocked) / len(p), 9), round(len(p & blocked) / 200, 9))
    want = {tuple(r.needs) for r in rules}
    # matching through the index: a page is blocked if, and only if, some rule's tokens are all there
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", urlrules.tokens(F.col("url")).alias("t")).collect()}
    for r in urlrules.judge(pages, labels).collect():
        assert (r.verdict == "block") == any(set(c) <= tokens[r.page_id] for c in want)


def test_empty_tables_and_native_plan(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, None)], "page_id long, block boolean")
    out = urlrules.judge(pages, labels)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_url_on_many_pages_is_one_item(spark):
    url = "http://deep.example.org/" + "/".join(f"s{i}" for i in range(40))
    pages = spark.createDataFrame([(i, url) for i in range(50)] + [(100 + i, f"http://other.org/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 50) for i in [*range(50), *range(100, 160)]], "page_id long, block boolean")
    rules = urlrules.mine(pages, labels).collect()
    assert len(rules) == 1 and rules[0].confidence == 1.0 and len(rules[0].needs) > 40
    assert {r.verdict for r in urlrules.judge(pages, labels).filter("page_id < 50").collect()} == {"block"}
