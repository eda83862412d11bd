"""The 25 lexical URL features."""

from pyspark.sql import DataFrame, functions as F

from .constants import LEXICAL_FEATURES, SUSPICIOUS_WORDS
from .text import bigint, count_char, count_digits, count_special, count_words_present
from .urls import normalize_url, with_url_parts

# Which character each counter counts.
_COUNTED = {
    "num_dots": ".", "num_slashes": "/", "num_hyphens": "-", "num_underscores": "_",
    "num_at": "@", "num_question": "?", "num_equal": "=", "num_ampersand": "&",
    "num_percent": "%", "num_colons": ":", "num_semicolons": ";",
}


def with_lexical_features(df: DataFrame, url_col: str = "url", columns=None,
                          words=SUSPICIOUS_WORDS, prefix: str = "") -> DataFrame:
    """Add the lexical features of `url_col` as BIGINT columns; the URL column is kept as it is.

    `columns` restricts the output to some features; unused ones are never computed,
    because every feature is a native expression that Catalyst can prune. `prefix` is
    put before each output name.
    """
    chosen = list(LEXICAL_FEATURES if columns is None else columns)
    unknown = set(chosen) - set(LEXICAL_FEATURES)
    if unknown:
        raise ValueError(f"unknown lexical features: {sorted(unknown)}")
    kept = df.columns
    df = df.withColumn("__url", normalize_url(F.col(url_col)))
    df = with_url_parts(df, "__url", prefix="__p_")
    df = df.withColumn("__n_words", count_words_present(F.col("__url"), words))

    url, host, path = F.col("__url"), F.col("__p_host"), F.col("__p_path")
    feature = {
        "url_length": bigint(F.length(url)),
        "hostname_length": bigint(F.length(host)),
        "path_length": bigint(F.length(path)),
        "query_length": bigint(F.length("__p_query")),
        "num_digits": count_digits(url),
        "num_special_chars": count_special(url),
        "has_https": bigint(F.col("__p_scheme") == "https"),
        "has_ip": F.col("__p_has_ip"),
        "num_subdomains": F.greatest(F.lit(0).cast("bigint"), count_char(host, ".") - 1),
        "has_suspicious_word": bigint(F.col("__n_words") > 0),
        "num_suspicious_words": F.col("__n_words"),
        "has_double_slash": bigint(F.contains(path, F.lit("//"))),
        "has_encoded_characters": bigint(F.contains(url, F.lit("%"))),
        "has_port": F.col("__p_has_port"),
    }
    feature.update({name: count_char(url, char) for name, char in _COUNTED.items()})
    taken = [c for c in kept if c not in {prefix + name for name in chosen}]
    return df.select(*taken, *[feature[name].alias(prefix + name) for name in chosen])
