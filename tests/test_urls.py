"""Lexical features and URL parsing against fixed values and Python's own parser."""

import ipaddress
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from riskloom.functions.constants import LEXICAL_FEATURES, WHITESPACE
from riskloom.functions.groups import combine, domain_group, lexical_group
from riskloom.functions.lexical import with_lexical_features
from riskloom.functions.text import collapse_whitespace, count_digits, shannon_entropy, strip
from riskloom.functions.urls import normalize_url, with_url_parts

GOLDEN = {
    "https://google.com": [18, 10, 0, 0, 1, 2, 0, 0, 0, 4, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0],
    "https://www.microsoft.com": [25, 17, 0, 0, 2, 2, 0, 0, 0, 5, 0, 0, 0, 0, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0],
    "http://example.com/login": [24, 11, 6, 0, 1, 3, 0, 0, 0, 5, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0],
    "http://secure-login-account-verification.example.com":
        [52, 45, 0, 0, 2, 2, 3, 0, 0, 8, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1, 4, 0, 0, 0],
    "http://192.168.1.1/login": [24, 11, 6, 0, 3, 3, 0, 0, 8, 7, 0, 0, 0, 0, 0, 1, 0, 0, 1, 2, 1, 1, 0, 0, 0],
}

# url: host, path, query, has_port, has_ip
PARSED = {
    "http://HTTP://Google.com": ("http", "//Google.com", "", 0, 0),
    "http://a.com/b;c?x=1": ("a.com", "/b", "x=1", 0, 0),
    "http://a.com/x;1/y;2#f": ("a.com", "/x;1/y", "", 0, 0),
    "http://[::1]:80/": ("::1", "/", "", 1, 1),
    "http://[bad/": ("invalid", "", "", 0, 0),
    "http://a[b].com/": ("invalid", "", "", 0, 0),
    "http://℀.com": ("invalid", "", "", 0, 0),
    "http://a.com:99999/": ("a.com", "/", "", 0, 0),
    "http://a.com:/": ("a.com", "/", "", 0, 0),
    "http://a.com:80:90/": ("a.com", "/", "", 0, 0),
    "http://u:p@H.com:80/a//b?q#f": ("h.com", "/a//b", "q", 1, 0),
    "http:///x": ("", "/x", "", 0, 0),
    "http://": ("", "", "", 0, 0),
    "http://ex ample.com/p": ("ex ample.com", "/p", "", 0, 0),
    "http://a.com?x=/": ("a.com", "", "x=/", 0, 0),
    "http://[fe80::1%25eth0]/": ("fe80::1%25eth0", "/", "", 0, 1),
    "http://x[::1]/": ("::1", "/", "", 0, 1),
    "http://1.2.3.04/": ("1.2.3.04", "/", "", 0, 0),
    "http://a.com\t/b\nc": ("a.com", "/bc", "", 0, 0),
    "": ("", "", "", 0, 0),
}


def test_golden_features(spark):
    df = spark.createDataFrame([(u,) for u in GOLDEN], "url string")
    for row in with_lexical_features(df).collect():
        assert [row[c] for c in LEXICAL_FEATURES] == GOLDEN[row["url"]], row["url"]


def test_parser_edge_cases(spark):
    df = spark.createDataFrame([(u,) for u in PARSED], "url string")
    for r in with_url_parts(df).collect():
        assert (r["host"], r["path"], r["query"], r["has_port"], r["has_ip"]) == PARSED[r["url"]], r["url"]


def test_random_urls_match_python_parser(spark):
    rng = random.Random(7)
    pieces = list("aZ09.-_:/?#@;=&%[]~ \t") + ["http://", "1.2.3.4", "::1", "login", "é", "😀", "²", "//", ":80", "%41", "ｆ", "："]
    urls = sorted({"http://" + "".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)})
    df = with_url_parts(with_lexical_features(spark.createDataFrame([(u,) for u in urls], "url string"), prefix="f_"))
    for r in df.collect():
        url = r["url"]
        try:
            p = urlparse(url)
        except ValueError:
            p = urlparse("http://invalid")
        host = p.hostname or ""
        try:
            port = int(p.port is not None) if host else 0
        except ValueError:
            port = 0
        try:
            ipaddress.ip_address(host)
            ip = 1
        except ValueError:
            ip = 0
        got = (r["host"], r["path"], r["params"], r["query"], r["fragment"], r["has_port"], r["has_ip"])
        assert got == (host, p.path, p.params, p.query, p.fragment, port, ip), url
        stripped = url.strip()
        assert r["f_num_digits"] == sum(c.isdigit() for c in stripped), url
        assert r["f_url_length"] == len(stripped), url
        assert r["f_num_dots"] == stripped.count("."), url


@pytest.mark.parametrize("insensitive,expected", [(False, "http://HTTP://b.com"), (True, "HTTP://b.com")])
def test_upper_case_scheme(spark, insensitive, expected):
    df = spark.createDataFrame([("HTTP://b.com",)], "u string")
    assert df.select(normalize_url(F.col("u"), insensitive)).first()[0] == expected


def test_normalize_is_idempotent_and_total(spark):
    raw = [None, "", "  ", "a.com", " https://x ", "　a.com ", "http://"]
    df = spark.createDataFrame([(u,) for u in raw], "u string").select(normalize_url(F.col("u")).alias("u"))
    once = [r[0] for r in df.collect()]
    assert once == ["", "", "", "http://a.com", "https://x", "http://a.com", "http://"]
    assert [r[0] for r in df.select(normalize_url(F.col("u"))).collect()] == once


def test_text_functions(spark):
    samples = ["", "aab", "  x\t", WHITESPACE + "y" + WHITESPACE, "a²③٣b", "abcdefghijklmnop", "a  b\t\tc d　　e"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    s = F.col("s")
    rows = df.select("s", strip(s).alias("strip"), count_digits(s).alias("d"), shannon_entropy(s).alias("h"),
                     collapse_whitespace(s).alias("w")).collect()
    import math
    import re
    for r in rows:
        t = r["s"]
        assert r["strip"] == t.strip()
        assert r["d"] == sum(c.isdigit() for c in t)
        assert r["w"] == re.sub(r"\s\s+", " ", t)
        h = -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
        assert abs(r["h"] - h) < 1e-12
    assert [r["h"] for r in rows if r["s"] == "abcdefghijklmnop"] == [4.0]


def test_groups():
    assert len(lexical_group("all")) == 25 and len(lexical_group("all_minus_redundant")) == 23
    both = combine(lexical_group("all_minus_redundant"), domain_group("all"))
    assert len(both) == 38 and both.count("num_subdomains") == 1


def test_unknown_feature_is_refused(spark):
    with pytest.raises(ValueError):
        with_lexical_features(spark.createDataFrame([("a",)], "url string"), columns=["nope"])
