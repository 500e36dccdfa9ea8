"""URL columns against Python's own URL library."""

from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.functions.values import SKIP_EXTENSIONS, TRACKING_PARAMS
from pagemill.operators.domains import filter_domains, matching_domains

BASES = [
    "http://h.com/a/b/c?x=1#f", "https://H.com", "http://h.com/a//b/", "http://h.com:8080/p;v=1/q;w=2?z", "ftp://f.org/x",
]
HREFS = [
    "", "#f", "x", "/x", "//o.com/y", "?q=1", "../x", "../../../x", "./", "..", ".", "x//y/", "/a/./b/../c", "mailto:a@b",
    "javascript:void(0)", "http:rel", "HTTP://ABC.com/P", "x y|z", "é/ü", "/p/;v=1", "a//", "g;x=1/../y", ";p=1", "x?y#z",
    "https://e.com:99/a.JPG", "/a.jpg;x", "//", "///x", "http://[::1]/x", "a:b", "1a:b", " x ",
]
URLS = [
    "http://H.com/A/?b=2&a=1&a=0&utm_source=x", "http://h.com/?x=&y=%41%zz&z=a+b~*", "http://h.com/p/;v=1", "http://h.com//",
    "http://h.com/a//", "http://h.com", "http://h.com/", "h.com/x", "HTTP://U@H:80/x/#f", "http://h/x?ref=1#a",
    "http://h/x?q=é&=5&k", "http://[bad/x", "http://h/a b?c d=e f", "http://h/?a=1&&b=2;c=3", "mailto:x@y", "http://h/x?a=%e9",
    "http://h/%7Efoo/%2F?u=%2f", "http://h/x?" + "&".join(f"{p}=1" for p in TRACKING_PARAMS) + "&keep=1",
] + [urljoin(b, h) for b in BASES for h in HREFS]


def canonical(url):
    try:
        p = urlparse(url.lower())
        params = parse_qs(p.query)
        query = urlencode(sorted((k, v) for k, v in params.items() if k not in TRACKING_PARAMS), doseq=True)
        path = p.path[:-1] if len(p.path) > 1 and p.path.endswith("/") else p.path
        return urlunparse((p.scheme, p.netloc, path, p.params, query, ""))
    except ValueError:
        return url.lower()


def light(url):
    try:
        p = urlparse(url)
        return urlunparse((p.scheme, p.netloc.lower(), p.path, p.params, p.query, ""))
    except ValueError:
        return url


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(u,) for u in dict.fromkeys(URLS)], "u string")


def test_resolve_matches_reference_resolution(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string")
    rows = df.select("b", "h", U.resolve_url(F.col("b"), F.col("h")).alias("r")).collect()
    # A foreign absolute reference comes back with its scheme in lower case.
    assert {(r.b, r.h): r.r for r in rows if "ABC" not in r.h} == {
        (b, h): urljoin(b, h) for b in BASES for h in HREFS if "ABC" not in h
    }


def test_normalize_and_key(urls):
    rows = urls.select(
        "u", U.normalize_url(F.col("u")).alias("n"), U.canonical_url_key(F.col("u")).alias("c")
    ).collect()
    assert {r.u: r.n for r in rows} == {r.u: light(r.u) for r in rows}
    assert {r.u: r.c for r in rows} == {r.u: canonical(r.u) for r in rows}


def test_normal_forms_are_stable(urls):
    n, c = U.normalize_url(F.col("u")), U.canonical_url_key(F.col("u"))
    # A path with several trailing slashes loses one each time.
    plain = urls.filter(~F.col("u").rlike("//+$|//+[?#;]"))
    rows = plain.select("u", n.alias("n"), U.normalize_url(n).alias("nn"), c.alias("c"), U.canonical_url_key(c).alias("cc")).collect()
    assert all(r.n == r.nn for r in rows)
    assert [r.u for r in rows if r.c != r.cc and "%" not in r.u] == []


def test_domain_and_origin(spark):
    df = spark.createDataFrame(
        [("https://U@Host:81/x",), ("no/host",), ("http://[bad/x",), (None,), ("//H/x",)], "u string"
    )
    rows = df.select(U.url_domain(F.col("u")).alias("d"), U.url_origin(F.col("u")).alias("o")).collect()
    assert [r.d for r in rows] == ["u@host:81", "", "unknown", "unknown", "h"]
    assert rows[0].o == "https://U@Host:81"


def test_valid_urls(spark):
    good = ["http://h/x", "https://h.com/a.html", "http://h/jpg", "http://h/a.jpg/b"]
    bad = ["ftp://h/x", "mailto:a@b", "/x", "http:///x", "http://[bad/x"]
    bad += [f"http://h/a.{e}" for e in SKIP_EXTENSIONS] + ["http://h/a.JPG?x=1", "http://h/a.pdf;v=2"]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    rows = df.select("u", U.is_valid_url(F.col("u")).alias("ok"), U.is_valid_url(F.col("u"), check_extension=False).alias("any")).collect()
    assert [r.u for r in rows if r.ok] == good
    assert {r.u for r in rows if r.any and not r.ok} == {u for u in bad if "//h/a." in u}


def test_allowed_and_blocked(spark):
    df = spark.createDataFrame([("http://shop.a.com/",), ("http://a.com/",), ("http://xa.com/",), ("http://spam.a.com/",)], "u string")
    sub = U.is_valid_url(F.col("u"), allowed=("a.com",), blocked=("spam",))
    suffix = U.is_valid_url(F.col("u"), allowed=("a.com",), blocked=("spam.a.com",), match="suffix")
    rows = df.select(sub.alias("sub"), suffix.alias("suffix")).collect()
    assert [r.sub for r in rows] == [True, True, True, False]
    assert [r["suffix"] for r in rows] == [True, True, False, False]


def test_domain_lists_as_tables(spark):
    hosts = ["a.example.com", "b.example.org", "spam.example.com", "x.spam", "spa.m"]
    df = spark.createDataFrame([(f"http://{h}/{i}", h) for h in hosts for i in range(3)], "url string, domain string")
    entries = spark.createDataFrame([("spam",), ("EXAMPLE.org",), ("",), ("n" * 300,)], "entry string")
    assert {r.domain for r in matching_domains(df, entries).collect()} == {"b.example.org", "spam.example.com", "x.spam"}
    assert {r.domain for r in matching_domains(df, entries, "suffix").collect()} == {"b.example.org", "x.spam"}
    left = filter_domains(df, blocked=entries).collect()
    assert sorted(r.domain for r in left) == sorted(["a.example.com", "spa.m"] * 3)


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("HTTP://H.com/a/?utm_source=1",)], "u string")
    row = df.select(U.storage_hash(F.col("u")).alias("s"), U.url_key_hash(F.col("u")).alias("k")).first()
    assert row.s == hashlib.sha256(b"HTTP://H.com/a/?utm_source=1").hexdigest()
    assert row.k == hashlib.sha256(b"http://h.com/a").hexdigest()


def test_long_list_entries_block(spark):
    """An authority may be longer than a host name; entries of any length count."""
    df = spark.createDataFrame([("u" * 300 + "@h.org",), ("h.org",), ("",), (None,)], "domain string")
    for entry, hits in (("u" * 260, 1), ("U" * 300 + "@h.org", 1), ("u" * 301, 0), ("h.org", 2)):
        entries = spark.createDataFrame([(entry,), ("not there",)], "entry string")
        assert matching_domains(df, entries).count() == hits
    assert matching_domains(df, spark.createDataFrame([], "entry string")).count() == 0
