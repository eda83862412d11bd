"""Tables that the registered queries read, derived by Spark from the given ones."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Small suffix-rule lists for the hosts in the given tables.
RULES = [("com", "normal"), ("net", "normal"), ("org", "normal"), ("uk", "normal"), ("co.uk", "normal")]
DEEP_RULES = RULES + [
    ("example.com", "normal"), ("example.net", "wildcard"), ("example.org", "wildcard"),
    ("tionble.example.org", "exception"), ("tiontion.example.net", "exception"),
]
SPECIAL_RULES = RULES + [("123", "normal")]
#: A domain of 36 different characters.
LONG_DOMAIN = "abcdefghijklmnopqrstuvwxyz0123456789.com"


#: A forest of two trees over lexical features: (tree, node, feature, threshold, left node, right node, class shares).
GIVEN_FOREST = [
    (0, 0, "url_length", 60.0, 1, 2, [0.5, 0.5]), (0, 1, "num_digits", 2.0, 3, 4, [0.6, 0.4]), (0, 2, None, None, None, None, [0.1, 0.9]),
    (0, 3, None, None, None, None, [0.8, 0.2]), (0, 4, None, None, None, None, [0.3, 0.7]),
    (1, 0, "path_length", 20.0, 1, 2, [0.5, 0.5]), (1, 1, None, None, None, None, [0.75, 0.25]), (1, 2, "query_length", 0.0, 3, 4, [0.2, 0.8]),
    (1, 3, None, None, None, None, [0.4, 0.6]), (1, 4, None, None, None, None, [0.05, 0.95]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession, rows=RULES) -> DataFrame:
    return spark.createDataFrame(rows, "suffix string, kind string")


def labelled_pages(spark, sf_dir) -> DataFrame:
    """(row_id, url, type) of every page. The tables label no URL; the class here is the
    language section in the path, a synthetic stand-in."""
    section = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), "url", section.alias("type"))


def raw_urls(spark, sf_dir) -> DataFrame:
    """Five raw rows per page: as it is; without scheme, padded and labelled otherwise;
    with a missing URL token; with a blank URL; with a missing label token."""
    pages = labelled_pages(spark, sf_dir)
    bare = F.concat(F.lit("  "), F.regexp_replace("url", "^https?://", ""), F.lit("\t"))
    rows = F.array(
        F.struct(F.col("url").alias("url"), F.col("type").alias("type")),
        F.struct(bare.alias("url"), F.lit(" Benign\n").alias("type")),
        F.struct(F.lit("N/A").alias("url"), F.col("type").alias("type")),
        F.struct(F.lit("   ").alias("url"), F.col("type").alias("type")),
        F.struct(F.col("url").alias("url"), F.lit("null").alias("type")),
    )
    rows = pages.select("row_id", F.posexplode(rows).alias("v", "r"))
    return rows.select((F.col("row_id") * 5 + F.col("v")).alias("row_id"), "r.url", "r.type")


def decorated_urls(spark, sf_dir) -> DataFrame:
    """(row_id, url): four variants of each page URL with user info, port, capitals, params,
    percent codes, an IP host, and a malformed authority."""
    scheme, rest = F.regexp_extract("url", "^(https?)://", 1), F.regexp_replace("url", "^https?://", "")
    host, tail = F.substring_index(rest, "/", 1), F.regexp_replace(rest, "^[^/]*", "")
    rows = F.array(
        F.concat(scheme, F.lit("://Login:secret@"), F.upper(host), F.lit(":8080/"), tail),
        F.concat(scheme, F.lit("://"), host, F.lit(":99999/a;x=1/b;y=%20?verify="), tail),
        F.concat(F.lit("http://10.20.30.40:/update-account"), tail),
        F.concat(F.lit("https://["), host, F.lit("/bank"), tail),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(rows).alias("v", "url"))
    return rows.select((F.col("page_id") * 4 + F.col("v")).alias("row_id"), "url")


def special_urls(spark, sf_dir) -> DataFrame:
    """(row_id, url): each page under a host with four more labels, with a punycode label, with a numeric suffix, and of a
    long domain."""
    rest = F.regexp_replace("url", "^https?://", "")
    host, tail = F.substring_index(rest, "/", 1), F.regexp_replace(rest, "^[^/]*", "")
    rows = F.array(
        F.concat(F.lit("http://a.b.c.d."), host, tail),
        F.concat(F.lit("http://xn--bcher-kva."), host, tail),
        F.concat(F.lit("http://"), host, F.lit(".123"), tail),
        F.concat(F.lit(f"http://{LONG_DOMAIN}"), tail),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(rows).alias("v", "url"))
    return rows.select((F.col("page_id") * 4 + F.col("v")).alias("row_id"), "url")


def rule_predictions(spark, sf_dir) -> DataFrame:
    """(row_id, actual, predicted): a fixed rule guesses the class of a page from its URL."""
    guess = (
        F.when(F.contains("url", F.lit("utm_source")), "fr")
        .when(F.contains("url", F.lit("#top")), "de")
        .when(F.contains("url", F.lit(".html")), "es")
        .when(F.contains("url", F.lit("page=2")), "other")
        .otherwise("en")
    )
    return labelled_pages(spark, sf_dir).select("row_id", F.col("type").alias("actual"), guess.alias("predicted"))


def padded_pages(spark, sf_dir) -> DataFrame:
    """(row_id, url, type): each page URL with a query of 0 to 60 hash digits more. The class says whether the padded URL is
    longer than 85 characters, but for one row in 32, where it says the opposite: it is a noisy function of a lexical feature,
    and no text in the URL names it."""
    digits = F.concat(F.md5(F.concat(F.lit("a"), F.col("page_id"))), F.md5(F.concat(F.lit("b"), F.col("page_id"))))
    hashed = F.md5(F.concat(F.lit("c"), F.col("page_id")))
    length = (F.conv(F.substring(hashed, 1, 4), 16, 10).cast("long") % 61).cast("int")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat("url", F.when(F.contains("url", F.lit("?")), "&p=").otherwise("?p="), F.substring(digits, F.lit(1), length)).alias("url"),
        (F.conv(F.substring(hashed, 5, 4), 16, 10).cast("long") % 32 == 0).alias("flipped"))
    long = F.col("flipped") != (F.length("url") > 85)
    return pages.select(F.col("page_id").alias("row_id"), "url", F.when(long, "long").otherwise("short").alias("type"))


#: Arrivals of the raw URLs as a stream, in this order.
URL_ARRIVALS = 4
#: Arrivals of predictions; each one's labels come with the next.
LABEL_ARRIVALS = 4


def arriving_urls(spark, sf_dir) -> DataFrame:
    """(arrival, row_id, url, type, seen_at): first the raw rows without scheme, then the plain ones, then the others, then everything again
    under another label. An arrival comes a day after the one before."""
    raw = raw_urls(spark, sf_dir)
    variant = F.col("row_id") % 5
    arrival = F.when(variant == 1, 0).when(variant == 0, 1).otherwise(2)
    rows = raw.select(arrival.alias("arrival"), "row_id", "url", "type")
    again = raw.select(F.lit(3).alias("arrival"), "row_id", "url", F.lit("late").alias("type"))
    seen_at = F.timestamp_seconds(F.lit(1704067200) + F.col("arrival") * 86400 + F.col("row_id") % 3600)
    return rows.unionByName(again).withColumn("seen_at", seen_at)


def arriving_predictions(spark, sf_dir) -> DataFrame:
    """(arrival, row_id, actual, predicted, predicted_at, labelled_at): guesses of the fixed rule in hourly arrivals; labels come 0 to 89 minutes after them."""
    arrival = F.col("row_id") % (LABEL_ARRIVALS - 1)
    at = F.lit(1704067200) + arrival * 3600 + F.col("row_id") % 3600
    return rule_predictions(spark, sf_dir).select(
        arrival.alias("arrival"), "row_id", "actual", "predicted", F.timestamp_seconds(at).alias("predicted_at"),
        F.timestamp_seconds(at + F.col("row_id") % 90 * 60).alias("labelled_at"))
