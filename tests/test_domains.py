import pytest
from pyspark.sql import functions as F

from riskloom.functions.constants import DOMAIN_FEATURES
from riskloom.operators import domains, joins
from riskloom.operators.domains import parse_rules, with_domain_features, with_domain_split, with_punycode_rules

GOLDEN = {
    "https://google.com": [10, 6, 3, 0, 0, 2, 0, 0, 0, 0.0, 0.0, 1.9183, 0, 0, 0, 0],
    "https://login.accounts.example.co.uk/path": [13, 7, 5, 14, 2, 5, 0, 0, 0, 0.0, 0.0, 2.5216, 0, 0, 0, 0],
    "http://192.168.1.1/login": [11, 11, 0, 0, 0, 4, 8, 0, 3, 0.727273, 0.0, 2.2999, 0, 0, 0, 0],
    "https://xn--80ak6aa92e.com/": [18, 14, 3, 0, 0, 2, 5, 2, 2, 0.357143, 0.142857, 3.3249, 1, 0, 0, 0],
    "https://x7q9k2m8z1.example.net": [11, 7, 3, 10, 1, 3, 0, 0, 0, 0.0, 0.0, 2.5216, 0, 0, 0, 0],
    "https://secure-login-account-verification.example.com": [11, 7, 3, 33, 1, 3, 0, 0, 0, 0.0, 0.0, 2.5216, 0, 0, 0, 0],
}
# host: subdomain, domain, suffix, registered
SPLITS = {
    "google.com": ("", "google", "com", "google.com"),
    "login.accounts.example.co.uk": ("login.accounts", "example", "co.uk", "example.co.uk"),
    "co.uk": ("", "", "co.uk", "co.uk"),
    "localhost": ("", "localhost", "", "localhost"),
    "foo.invalid": ("foo", "invalid", "", "invalid"),
    "": ("", "", "", ""),
    "a.b.ck": ("", "a", "b.ck", "a.b.ck"),
    "b.ck": ("", "", "b.ck", "b.ck"),
    "x.www.ck": ("x", "www", "ck", "www.ck"),
    "ck": ("", "ck", "", "ck"),
    "example.com.": ("", "example", "com", "example.com"),
    "a..com": ("a", "", "com", "com"),
    "x.xn--fiqs8s": ("", "x", "xn--fiqs8s", "x.xn--fiqs8s"),
    "x.中国": ("", "x", "中国", "x.中国"),
}
RULES = ["// comment", "com", "net", "uk", "co.uk", "*.ck", "!www.ck", "", "中国"]


@pytest.fixture(scope="module")
def rules(spark):
    return with_punycode_rules(parse_rules(spark.createDataFrame([(r,) for r in RULES], "value string")))


def test_golden_features(spark, rules):
    df = spark.createDataFrame([(u,) for u in GOLDEN], "url string")
    for r in with_domain_features(df, rules).collect():
        assert [round(r[c], 6) for c in DOMAIN_FEATURES] == GOLDEN[r["url"]], r["url"]


def _splits(spark, rules):
    df = with_domain_split(spark.createDataFrame([(h,) for h in SPLITS], "host string"), rules)
    return {r["host"]: (r["subdomain"], r["domain"], r["suffix"], r["registered_domain"]) for r in df.collect()}


def test_splits(spark, rules):
    assert _splits(spark, rules) == SPLITS


def test_splits_with_a_rule_table_too_large_to_broadcast(spark, rules, monkeypatch):
    monkeypatch.setattr(domains, "lookup_bytes", lambda table, key: joins.BROADCAST_BYTES + 1)
    assert _splits(spark, rules) == SPLITS


def test_split_shuffles_nothing(spark, rules):
    df = with_domain_split(spark.range(10).select(F.lit("a.com").alias("host")), rules)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_hot_keys_are_joined_exactly(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, F.lit(None)).when(F.col("id") < 2500, 7).otherwise(F.col("id") % 40).alias("k")
    )
    table = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(table, "k", how).select("id", "k", "v").collect()))
        got = joins.lookup_join(left, table, "k", how, max_bytes=0)
        assert sorted(map(tuple, got.select("id", "k", "v").collect())) == want
