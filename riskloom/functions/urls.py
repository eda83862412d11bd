"""URL normalisation and parsing as native column expressions.

The rules are those of Python's `urllib.parse`. Spark's own `parse_url` differs:
it rejects blanks and underscores, keeps `;params` in the path and does not
lower-case the host.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .constants import IPV4, IPV6, IPV_FUTURE, PORT, SPLITTING_CHARS
from .text import bigint, strip

URL_PARTS = ["scheme", "netloc", "host", "path", "params", "query", "fragment", "has_port", "has_ip"]


def normalize_url(col: Column, case_insensitive_scheme: bool = False) -> Column:
    """Strip, and put `http://` in front unless the URL has an http(s) scheme.

    NULL and blank give ''. The scheme test is case-sensitive, so `HTTP://x` gets a
    second scheme; `case_insensitive_scheme=True` turns that off.
    """
    scheme = "(?i)https?://" if case_insensitive_scheme else "https?://"
    # An empty match at the start of a non-empty URL without scheme is where the prefix goes.
    missing = rf"\A(?!{scheme})(?=[\s\S])"
    return F.coalesce(F.regexp_replace(strip(col.cast("string")), missing, "http://"), F.lit(""))


def _after(whole: Column, head: Column, skip: int = 1) -> Column:
    """What follows `head` and `skip` separator characters in `whole`."""
    return F.substring(whole, F.length(head) + F.lit(skip + 1), F.length(whole))


def with_url_parts(df: DataFrame, url_col: str = "url", prefix: str = "") -> DataFrame:
    """Add scheme, netloc, host, path, params, query, fragment, has_port and has_ip.

    `url_col` holds normalised URLs. A malformed authority gives the parts of
    `http://invalid`. Each step is one projection, so no sub-expression is repeated.
    """
    name = {p: prefix + p for p in URL_PARTS}
    t = {k: f"__{k}" for k in ("clean", "nofrag", "base", "netloc", "raw", "hostinfo", "host0", "port", "bad")}
    c = {k: F.col(v) for k, v in t.items()}
    bracketed = F.contains(c["hostinfo"], F.lit("["))

    df = df.withColumn(t["clean"], F.regexp_replace(F.col(url_col), "[\t\r\n]", ""))
    df = df.withColumn(t["nofrag"], F.substring_index(c["clean"], "#", 1))
    df = df.withColumn(t["base"], F.substring_index(c["nofrag"], "?", 1))
    head = F.lower(F.substring(c["clean"], 1, 8))
    scheme = F.when(head.startswith("https://"), "https").when(head.startswith("http://"), "http").otherwise("")
    df = df.withColumn(name["scheme"], scheme)
    df = df.withColumn(
        t["netloc"],
        F.when(F.col(name["scheme"]) == "", "").otherwise(
            F.substring_index(_after(c["base"], F.col(name["scheme"]), 3), "/", 1)
        ),
    )
    df = df.withColumn(t["hostinfo"], F.substring_index(c["netloc"], "@", -1))
    df = df.withColumns({
        t["bad"]: _malformed(c["netloc"]),
        t["raw"]: F.when(F.col(name["scheme"]) == "", c["base"]).otherwise(
            _after(c["base"], F.concat(F.col(name["scheme"]), c["netloc"]), 3)
        ),
        t["host0"]: F.when(bracketed, F.regexp_extract(c["hostinfo"], r"(?s)\[([^\]]*)", 1))
        .otherwise(F.substring_index(c["hostinfo"], ":", 1)),
        t["port"]: F.when(bracketed, F.regexp_extract(c["hostinfo"], r"(?s)\][^:]*:(.*)$", 1))
        .otherwise(_after(c["hostinfo"], F.substring_index(c["hostinfo"], ":", 1))),
    })
    # Only the last path segment can carry ;params.
    segment = F.substring_index(c["raw"], "/", -1)
    params = F.when(
        F.contains(segment, F.lit(";")), _after(segment, F.substring_index(segment, ";", 1))
    ).otherwise(F.lit(""))
    has_params = F.contains(segment, F.lit(";"))
    host = c["host0"]
    zone_free = F.substring_index(host, "%", 1)
    df = df.withColumns({
        name["netloc"]: F.when(c["bad"], "invalid").otherwise(c["netloc"]),
        name["host"]: F.when(c["bad"], "invalid")
        .when(F.contains(host, F.lit("%")), F.concat(F.lower(zone_free), _after(host, zone_free, 0)))
        .otherwise(F.lower(host)),
        name["params"]: F.when(c["bad"], "").otherwise(params),
        name["path"]: F.when(c["bad"], "")
        .when(has_params, F.substring(c["raw"], F.lit(1), F.length(c["raw"]) - F.length(params) - 1))
        .otherwise(c["raw"]),
        name["query"]: F.when(c["bad"], "").otherwise(_after(c["nofrag"], c["base"])),
        name["fragment"]: F.when(c["bad"], "").otherwise(_after(c["clean"], c["nofrag"])),
        name["scheme"]: F.when(c["bad"], "http").otherwise(F.col(name["scheme"])),
    })
    host = F.col(name["host"])
    df = df.withColumns({
        name["has_port"]: bigint(
            F.when(c["bad"] | (host == ""), F.lit(False)).otherwise(F.rlike(c["port"], F.lit(rf"\A{PORT}\z")))
        ),
        name["has_ip"]: bigint(is_ip(host)),
    })
    return df.drop(*t.values())


def is_ip(host: Column) -> Column:
    """True for an IPv4 or IPv6 literal; the long IPv6 pattern runs only where ':' occurs."""
    return F.when(F.contains(host, F.lit(":")), F.rlike(host, F.lit(rf"\A({IPV6})\z"))).otherwise(
        F.rlike(host, F.lit(rf"\A({IPV4})\z"))
    )


def _malformed(netloc: Column) -> Column:
    """Authorities that the parser rejects: unbalanced or invalid brackets, splitting characters."""
    opened, closed = F.contains(netloc, F.lit("[")), F.contains(netloc, F.lit("]"))
    inner = F.regexp_extract(netloc, r"(?s)^[^\[]*\[([^\]]*)", 1)
    valid = F.when(inner.startswith("v"), F.rlike(inner, F.lit(rf"\A{IPV_FUTURE}\z"))).otherwise(
        F.rlike(inner, F.lit(rf"\A({IPV6})\z"))
    )
    return (
        F.when(opened != closed, True)
        .when(opened & closed, ~valid | F.rlike(netloc, F.lit(SPLITTING_CHARS)))
        .otherwise(F.rlike(netloc, F.lit(SPLITTING_CHARS)))
    )
