"""Registered-domain split by public-suffix rules, and the 16 domain features."""

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import (
    DOMAIN_FEATURES, DIGIT_CLASS, HIGH_ENTROPY_THRESHOLD, LONG_SUBDOMAIN_THRESHOLD, OTHER_DOTS,
)
from ..functions.text import bigint, count_char, count_digits, count_labels, count_special, shannon_entropy, strip
from ..functions.urls import normalize_url, with_url_parts
from ..sources.staging import checkpoint
from .joins import lookup_bytes, lookup_join

SPLIT_COLUMNS = ["subdomain", "domain", "suffix", "registered_domain"]


PRIVATE_BEGIN, PRIVATE_END = "===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS==="


def parse_rules(lines: DataFrame, line_col: str = "value", include_private: bool = False) -> DataFrame:
    """Rule table (suffix, kind) from lines in the public-suffix-list notation, in the order of the file.

    The section of private registries, which comment lines mark, is left out unless asked for.
    """
    rule = F.lower(F.split(strip(F.col(line_col)), r"\s")[0])
    if not include_private:
        lines = lines.select(line_col).withColumn("line", F.monotonically_increasing_id())
        marks = lines.filter(strip(F.col(line_col)).startswith("//")).agg(
            F.min(F.when(F.contains(line_col, F.lit(PRIVATE_BEGIN)), F.col("line"))),
            F.max(F.when(F.contains(line_col, F.lit(PRIVATE_END)), F.col("line"))),
        ).first()
        if marks[0] is not None:
            last = marks[1] if marks[1] is not None else (1 << 63) - 1
            lines = lines.filter((F.col("line") < marks[0]) | (F.col("line") > last))
    lines = lines.select(rule.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    kind = (
        F.when(F.col("rule").startswith("!"), "exception")
        .when(F.col("rule").startswith("*."), "wildcard")
        .otherwise("normal")
    )
    return lines.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind"))


def with_punycode_rules(rules: DataFrame) -> DataFrame:
    """Add the ASCII (xn--) spelling of rules written in Unicode, so both match hosts."""
    def to_ascii(batches):
        for batch in batches:
            batch["suffix"] = [
                ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in s.split("."))
                for s in batch["suffix"]
            ]
            yield batch

    other = rules.filter(F.rlike("suffix", F.lit(r"[^\x00-\x7f]"))).select("suffix", "kind")
    return rules.select("suffix", "kind").unionByName(other.mapInPandas(to_ascii, "suffix string, kind string"))


def with_domain_split(df: DataFrame, rules: DataFrame, host_col: str = "host", is_ip_col: str = None,
                      prefix: str = "") -> DataFrame:
    """Add subdomain, domain, suffix and registered_domain of the host.

    The rule with the most labels wins; an exception rule beats all others. `rules` has
    one join per label depth of the longest rule (the public list has about five), each
    against the same small table: with a broadcast rule table the split is a narrow pass
    over `df` without any shuffle, also in a stream. An unknown TLD gives an empty suffix
    and the last label as domain; an IP address is its own domain.
    """
    kinds = ("normal", "wildcard", "exception")
    table = rules.filter(F.col("suffix") != "").groupBy("suffix").agg(
        *[F.max(F.col("kind") == k).alias(k) for k in kinds]
    )
    table = checkpoint(table)
    size = lookup_bytes(table, "suffix")
    depth = table.agg(F.max(count_char(F.col("suffix"), "."))).first()[0]
    depth = 0 if depth is None else depth + 1

    kept = df.columns
    host = strip(F.translate(F.coalesce(F.col(host_col), F.lit("")), OTHER_DOTS, "." * len(OTHER_DOTS)))
    df = df.withColumn("__host", F.rtrim(host, F.lit(".")))
    df = df.withColumn("__labels", count_char(F.col("__host"), ".") + 1)
    for k in range(1, depth + 1):
        candidate = F.when(F.col("__labels") >= k, F.substring_index("__host", ".", -k))
        renamed = table.select(
            F.col("suffix").alias(f"__c{k}"), *[F.col(kind).alias(f"__{kind}{k}") for kind in kinds]
        )
        df = lookup_join(df.withColumn(f"__c{k}", candidate), renamed, f"__c{k}", "left", size=size)

    # Labels in the suffix: an exception drops its own first label, a wildcard adds one.
    longest, excepted = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    for k in range(1, depth + 1):
        longest = (
            F.when(F.col(f"__wildcard{k}") & (F.col("__labels") > k), F.lit(k + 1))
            .when(F.col(f"__normal{k}"), F.greatest(longest, F.lit(k)))
            .otherwise(longest)
        )
        excepted = F.when(F.col(f"__exception{k}"), F.lit(k - 1)).otherwise(excepted)
    is_ip = F.col(is_ip_col) == 1 if is_ip_col else F.lit(False)
    df = df.withColumn("__take", F.when(is_ip, F.lit(0)).otherwise(F.coalesce(excepted, longest)).cast("int"))
    suffix = F.when(F.col("__take") > 0, F.expr("substring_index(__host, '.', -__take)")).otherwise(F.lit(""))
    df = df.withColumn("__suffix", suffix)
    rest = (
        F.when(F.col("__take") == 0, F.col("__host"))
        .when(F.col("__take") >= F.col("__labels"), F.lit(""))
        .otherwise(F.substring("__host", F.lit(1), F.length("__host") - F.length("__suffix") - 1))
    )
    df = df.withColumn("__rest", rest)
    df = df.withColumn("__domain", F.substring_index("__rest", ".", -1))
    cut = F.length("__rest") - F.length("__domain") - 1
    subdomain = F.when(is_ip, F.lit("")).when(cut > 0, F.substring("__rest", F.lit(1), cut)).otherwise(F.lit(""))
    domain = (
        F.when(is_ip, F.col(host_col))
        .when(F.col("__domain") != "", F.col("__domain"))
        .when(F.col("__suffix") == "", F.coalesce(F.col(host_col), F.lit("")))
        .otherwise(F.lit(""))
    )
    df = df.withColumn("__sub", subdomain).withColumn("__dom", domain)
    registered = (
        F.when(F.col("__dom") == "", F.col("__suffix"))
        .when(F.col("__suffix") == "", F.col("__dom"))
        .otherwise(F.concat_ws(".", "__dom", "__suffix"))
    )
    parts = {"subdomain": F.col("__sub"), "domain": F.col("__dom"), "suffix": F.col("__suffix"), "registered_domain": registered}
    return df.select(*kept, *[parts[c].alias(prefix + c) for c in SPLIT_COLUMNS])


def with_domain_features(df: DataFrame, rules: DataFrame, url_col: str = "url", columns=None,
                         prefix: str = "") -> DataFrame:
    """Add the domain features of `url_col`: 13 BIGINT and 3 DOUBLE columns.

    `prefix` is put before each output name, so that both feature families can be kept
    side by side although each has a `num_subdomains`.
    """
    chosen = list(DOMAIN_FEATURES if columns is None else columns)
    unknown = set(chosen) - set(DOMAIN_FEATURES)
    if unknown:
        raise ValueError(f"unknown domain features: {sorted(unknown)}")
    taken = [c for c in df.columns if c not in {prefix + name for name in chosen}]
    df = df.withColumn("__url", normalize_url(F.col(url_col)))
    df = with_url_parts(df, "__url", prefix="__p_")
    df = df.select(*taken, "__p_host", "__p_has_ip")
    df = with_domain_split(df, rules, "__p_host", "__p_has_ip", prefix="__d_")

    host, domain, suffix = F.col("__p_host"), F.col("__d_domain"), F.col("__d_suffix")
    df = df.withColumns({
        "__entropy": shannon_entropy(domain),
        "__digits": count_digits(domain),
        "__subs": count_labels(F.col("__d_subdomain")),
        "__size": bigint(F.length(domain)),
    })
    size = F.col("__size")
    feature = {
        "registered_domain_length": bigint(F.length("__d_registered_domain")),
        "domain_length": size,
        "tld_length": bigint(F.length(suffix)),
        "subdomain_length": bigint(F.length("__d_subdomain")),
        "num_subdomains": F.col("__subs"),
        "num_domain_labels": count_labels(host),
        "domain_num_digits": F.col("__digits"),
        "domain_num_hyphens": count_char(domain, "-"),
        "domain_num_special_chars": count_special(domain),
        "domain_digit_ratio": F.coalesce(F.try_divide(F.col("__digits"), size), F.lit(0.0)),
        "domain_hyphens_ratio": F.coalesce(F.try_divide(count_char(domain, "-"), size), F.lit(0.0)),
        "domain_entropy": F.round("__entropy", 4),
        "is_punycode": bigint(host.startswith("xn--") | F.contains(host, F.lit(".xn--"))),
        "has_long_subdomain": bigint(F.col("__subs") >= LONG_SUBDOMAIN_THRESHOLD),
        "is_numeric_tld": bigint(F.rlike(suffix, F.lit(rf"\A{DIGIT_CLASS}+\z"))),
        "high_domain_entropy": bigint(F.col("__entropy") > HIGH_ENTROPY_THRESHOLD),
    }
    return df.select(*taken, *[feature[name].alias(prefix + name) for name in chosen])
