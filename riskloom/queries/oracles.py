"""DuckDB twins of the registered queries, written from the specification of each operator."""

from ..functions.constants import (
    DOMAIN_FEATURES, LEXICAL_FEATURES, LEXICAL_GROUPS, NA_TOKENS, SUSPICIOUS_WORDS,
)
from .inputs import DEEP_RULES, LONG_DOMAIN, RULES, SPECIAL_RULES

# White space that is stripped, as SQL text.
WS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)"
    "||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


PAGES = "labelled AS (SELECT page_id AS row_id, url, regexp_extract(url, '/(en|fr|de|es)/', 1) AS type FROM pages)"

RAW = PAGES + """,
raw AS (
  SELECT row_id * 5 AS row_id, url, type FROM labelled
  UNION ALL SELECT row_id * 5 + 1, '  ' || regexp_replace(url, '^https?://', '') || chr(9), ' Benign' || chr(10) FROM labelled
  UNION ALL SELECT row_id * 5 + 2, 'N/A', type FROM labelled
  UNION ALL SELECT row_id * 5 + 3, '   ', type FROM labelled
  UNION ALL SELECT row_id * 5 + 4, url, 'null' FROM labelled
)"""


def normalized(col):
    s = f"trim({col}, {WS})"
    return (
        f"CASE WHEN {col} IS NULL OR {s} = '' THEN '' WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') "
        f"THEN {s} ELSE 'http://' || {s} END"
    )


CLEAN = RAW + f""",
tokens AS (
  SELECT row_id, CASE WHEN url IN ({quoted(NA_TOKENS)}) THEN NULL ELSE url END AS url,
         CASE WHEN type IN ({quoted(NA_TOKENS)}) THEN NULL ELSE type END AS type FROM raw
),
kept AS (
  SELECT row_id, {normalized('url')} AS url, trim(lower(type), {WS}) AS type
  FROM tokens WHERE url IS NOT NULL AND type IS NOT NULL
),
nonempty AS (SELECT * FROM kept WHERE length(url) > 0),
clean AS (
  SELECT row_id, url, type FROM nonempty
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_id) = 1
)"""

SCHEME, REST = "regexp_extract(url, '^(https?)://', 1)", "regexp_replace(url, '^https?://', '')"
DECORATED = f"""decorated_parts AS (
  SELECT page_id, {SCHEME} AS s, split_part({REST}, '/', 1) AS h, regexp_replace({REST}, '^[^/]*', '') AS t FROM pages
),
decorated AS (
  SELECT page_id * 4 AS row_id, s || '://Login:secret@' || upper(h) || ':8080/' || t AS url FROM decorated_parts
  UNION ALL SELECT page_id * 4 + 1, s || '://' || h || ':99999/a;x=1/b;y=%20?verify=' || t FROM decorated_parts
  UNION ALL SELECT page_id * 4 + 2, 'http://10.20.30.40:/update-account' || t FROM decorated_parts
  UNION ALL SELECT page_id * 4 + 3, 'https://[' || h || '/bank' || t FROM decorated_parts
)"""

SPECIAL = f"""special_parts AS (
  SELECT page_id, split_part({REST}, '/', 1) AS h, regexp_replace({REST}, '^[^/]*', '') AS t FROM pages
),
special AS (
  SELECT page_id * 4 AS row_id, 'http://a.b.c.d.' || h || t AS url FROM special_parts
  UNION ALL SELECT page_id * 4 + 1, 'http://xn--bcher-kva.' || h || t FROM special_parts
  UNION ALL SELECT page_id * 4 + 2, 'http://' || h || '.123' || t FROM special_parts
  UNION ALL SELECT page_id * 4 + 3, 'http://{LONG_DOMAIN}' || t FROM special_parts
)"""


PADDED = """hashed AS (SELECT page_id, url, md5('a' || page_id) || md5('b' || page_id) AS digits, md5('c' || page_id) AS h FROM pages),
padded AS (
  SELECT page_id AS row_id, url || CASE WHEN contains(url, '?') THEN '&p=' ELSE '?p=' END
         || substr(digits, 1, (('0x' || substr(h, 1, 4))::BIGINT % 61)::INT) AS url, ('0x' || substr(h, 5, 4))::BIGINT % 32 = 0 AS flipped FROM hashed
)"""


def parts(source):
    """CTE `parts`: the columns of `source` plus URL parts."""
    pattern = r"(?s)^(https?)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$"

    def group(k):
        return f"regexp_extract(clean_url, '{pattern}', {k})"

    return f"""
split0 AS (SELECT *, regexp_replace(url, '[\\t\\r\\n]', '', 'g') AS clean_url FROM {source}),
split1 AS (SELECT *, {group(2)} AS netloc0, {group(3)} AS raw_path FROM split0),
split2 AS (
  SELECT *, contains(netloc0, '[') <> contains(netloc0, ']') AS bad,
         regexp_replace(netloc0, '^.*@', '') AS hostinfo FROM split1
),
parts AS (
  SELECT * EXCLUDE (clean_url, netloc0, raw_path, hostinfo),
         CASE WHEN bad THEN 'http' ELSE {group(1)} END AS scheme,
         CASE WHEN bad THEN 'invalid' ELSE lower(split_part(hostinfo, ':', 1)) END AS host,
         CASE WHEN bad THEN '' ELSE regexp_replace(raw_path, ';[^/]*$', '') END AS path,
         CASE WHEN bad THEN '' ELSE {group(5)} END AS query,
         CASE WHEN bad THEN '' ELSE {group(7)} END AS fragment,
         CASE WHEN bad THEN 0 ELSE (coalesce(try_cast(regexp_extract(hostinfo, ':([0-9]+)$', 1) AS BIGINT), 99999)
              <= 65535)::BIGINT END AS has_port
  FROM split2
),
hosts AS (SELECT *, regexp_full_match(host, '{OCTET}([.]{OCTET}){{3}}')::BIGINT AS has_ip FROM parts)"""


def occurrences(col, char):
    return f"length({col}) - length(replace({col}, '{char}', ''))"


def lexical_sql():
    words = " + ".join(f"contains(lower(url), '{w}')::BIGINT" for w in SUSPICIOUS_WORDS)
    chars = {
        "num_dots": ".", "num_slashes": "/", "num_hyphens": "-", "num_underscores": "_", "num_at": "@",
        "num_question": "?", "num_equal": "=", "num_ampersand": "&", "num_percent": "%", "num_colons": ":",
        "num_semicolons": ";",
    }
    sql = {
        "url_length": "length(url)", "hostname_length": "length(host)", "path_length": "length(path)",
        "query_length": "length(query)",
        "num_digits": r"length(url) - length(regexp_replace(url, '\d', '', 'g'))",
        "num_special_chars": "length(regexp_replace(url, '[a-zA-Z0-9]', '', 'g'))",
        "has_https": "(scheme = 'https')", "has_ip": "has_ip",
        "num_subdomains": "greatest(0, len(string_split(host, '.')) - 2)",
        "has_suspicious_word": f"(({words}) > 0)", "num_suspicious_words": f"({words})",
        "has_double_slash": "contains(path, '//')", "has_encoded_characters": "contains(url, '%')",
        "has_port": "has_port",
    }
    sql.update({name: occurrences("url", char) for name, char in chars.items()})
    return sql


def lexical_list(names=LEXICAL_FEATURES):
    sql = lexical_sql()
    return ", ".join(f"({sql[n]})::BIGINT AS {n}" for n in names)


PAGE_URLS = f"urls AS (SELECT page_id, {normalized('url')} AS url FROM pages)"


def split_ctes(rules):
    """CTE `domains`: `hosts` plus subdomain, domain, suffix, registered_domain."""
    values = ", ".join(f"('{s}', '{k}')" for s, k in rules)
    return f"""
rules(suffix, kind) AS (VALUES {values}),
distinct_hosts AS (SELECT DISTINCT host, has_ip FROM hosts),
labels_of AS (SELECT host, has_ip, string_split(rtrim(host, '.'), '.') AS l FROM distinct_hosts),
candidates AS (
  SELECT host, l, k, array_to_string(l[len(l) - k + 1:], '.') AS tail
  FROM labels_of, unnest(range(1, len(l) + 1)) AS t(k) WHERE has_ip = 0
),
matches AS (
  SELECT host, k - 1 AS take, 1 AS rank FROM candidates JOIN rules ON tail = suffix AND kind = 'exception'
  UNION ALL SELECT host, k, 0 FROM candidates JOIN rules ON tail = suffix AND kind = 'normal'
  UNION ALL SELECT host, k + 1, 0 FROM candidates JOIN rules ON tail = suffix AND kind = 'wildcard' WHERE len(l) > k
),
taken AS (
  SELECT host, take FROM matches QUALIFY row_number() OVER (PARTITION BY host ORDER BY rank DESC, take DESC) = 1
),
cut AS (
  SELECT host, has_ip, l, coalesce(take, 0) AS m FROM labels_of LEFT JOIN taken USING (host)
),
named AS (
  SELECT host, has_ip, array_to_string(l[len(l) - m + 1:], '.') AS suffix,
         CASE WHEN has_ip = 1 THEN host WHEN m = len(l) THEN '' ELSE l[len(l) - m] END AS d0,
         CASE WHEN has_ip = 1 OR m >= len(l) - 1 THEN '' ELSE array_to_string(l[1:len(l) - m - 1], '.') END AS subdomain
  FROM cut
),
named2 AS (SELECT host, suffix, subdomain, CASE WHEN d0 = '' AND suffix = '' THEN host ELSE d0 END AS domain FROM named),
domains AS (
  SELECT h.*, n.subdomain, n.domain, n.suffix,
         CASE WHEN n.domain = '' THEN n.suffix WHEN n.suffix = '' THEN n.domain ELSE n.domain || '.' || n.suffix END
           AS registered_domain
  FROM hosts h JOIN named2 n USING (host)
),
chars AS (SELECT domain, unnest(string_split(domain, '')) AS ch FROM (SELECT DISTINCT domain FROM domains)),
freq AS (SELECT domain, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY domain) AS total FROM chars GROUP BY domain, ch),
entropies AS (SELECT domain, -sum(n / total * log2(n / total)) AS entropy FROM freq GROUP BY domain)"""


def domain_list(names=DOMAIN_FEATURES):
    sql = {
        "registered_domain_length": "length(registered_domain)", "domain_length": "length(domain)",
        "tld_length": "length(suffix)", "subdomain_length": "length(subdomain)",
        "num_subdomains": "len(list_filter(string_split(subdomain, '.'), lambda x: x <> ''))",
        "num_domain_labels": "len(list_filter(string_split(host, '.'), lambda x: x <> ''))",
        "domain_num_digits": r"length(domain) - length(regexp_replace(domain, '\d', '', 'g'))",
        "domain_num_hyphens": occurrences("domain", "-"),
        "domain_num_special_chars": "length(regexp_replace(domain, '[a-zA-Z0-9]', '', 'g'))",
        "is_punycode": "len(list_filter(string_split(host, '.'), lambda x: starts_with(x, 'xn--'))) > 0",
        "has_long_subdomain": "len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) >= 3",
        "is_numeric_tld": "regexp_full_match(suffix, '[0-9]+')",
        "high_domain_entropy": "coalesce(entropy, 0) > 4.0",
    }
    whole = {n: f"({s})::BIGINT" for n, s in sql.items()}
    size = "nullif(length(domain), 0)"
    whole["domain_digit_ratio"] = f"round(coalesce(({sql['domain_num_digits']}) / {size}, 0)::DOUBLE, 6)"
    whole["domain_hyphens_ratio"] = f"round(coalesce(({sql['domain_num_hyphens']}) / {size}, 0)::DOUBLE, 6)"
    whole["domain_entropy"] = "round(coalesce(entropy, 0)::DOUBLE, 4)"
    return ", ".join(f"{whole[n]} AS {n}" for n in names)


def domain_query(source_cte, source, rules, select):
    return f"WITH {source_cte}, {parts(source)}, {split_ctes(rules)} SELECT {select} FROM domains LEFT JOIN entropies USING (domain)"


def grams(source, id_col, text_col, name="terms"):
    """CTE (id, gram, tf) of whole texts."""
    ws = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2,}"
    # Texts are cut into overlapping pieces first: substring() counts from the start of its string.
    cut = " UNION ALL ".join(
        f"SELECT id, substring(t, i, {n}) AS gram FROM "
        f"(SELECT id, t, unnest(range(1, least(256, length(t) - {n - 1}) + 1)) AS i FROM {name}_pieces)"
        for n in (3, 4, 5)
    )
    return f"""
{name}_texts AS (SELECT {id_col} AS id, regexp_replace(lower({text_col}), '{ws}', ' ', 'g') AS t FROM {source}),
{name}_starts AS (SELECT id, t, unnest(range(1, length(t) + 1, 256)) AS s FROM {name}_texts),
{name}_pieces AS (SELECT id, substring(t, s, 260) AS t FROM {name}_starts),
{name} AS (SELECT id, gram, count(*) AS tf FROM ({cut}) GROUP BY id, gram)"""


def fitted(source, terms, limit=None):
    """CTE `vocab` (gram, df, total, idf) fitted on `source`."""
    top = f"ORDER BY total DESC, md5(gram) LIMIT {limit}" if limit else ""
    return f"""
size AS (SELECT count(*) AS n FROM {source}),
vocab AS (
  SELECT gram, df, total, ln((1.0 + n) / (1.0 + df)) + 1 AS idf
  FROM (SELECT gram, count(*) AS df, sum(tf)::BIGINT AS total FROM {terms} GROUP BY gram), size
  WHERE df >= 2 AND df <= 0.95 * n {top}
)"""


def weighted(terms):
    return f"""
weights AS (SELECT id, gram, tf, (1 + ln(tf)) * idf AS w FROM {terms} JOIN vocab USING (gram)),
unit AS (SELECT id, gram, tf, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM weights)"""


def quota_ctes(source, label, size):
    """CTE `quotas` (label, quota): `size` rows shared by largest remainder, ties by label."""
    return f"""
counts AS (SELECT {label} AS label, count(*)::HUGEINT AS n FROM {source} GROUP BY 1),
total AS (SELECT sum(n)::HUGEINT AS total, {size} AS wanted FROM counts),
shares AS (SELECT label, n, (wanted * n) // total AS whole, (wanted * n) % total AS remainder, wanted FROM counts, total),
quotas AS (
  SELECT label, whole + (row_number() OVER (ORDER BY remainder DESC, label)
         <= wanted - sum(whole) OVER ())::INT AS quota FROM shares
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || url), url) AS place FROM {source} s
),
marked AS (SELECT r.*, place <= quota AS inside FROM ranked r JOIN quotas q ON r.{label} = q.label)"""


TRAIN_SIZE = "(sum(n) - ceil(sum(n) * 0.2))::HUGEINT"
PAGE_SPLIT = f"""{PAGES}, {quota_ctes('labelled', 'type', TRAIN_SIZE)},
split AS (SELECT row_id, url, type, CASE WHEN inside THEN 'train' ELSE 'test' END AS split FROM marked),
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test')"""

GUESSES = PAGES + """,
rows_ AS (
  SELECT type AS actual, CASE WHEN contains(url, 'utm_source') THEN 'fr' WHEN contains(url, '#top') THEN 'de'
    WHEN contains(url, '.html') THEN 'es' WHEN contains(url, 'page=2') THEN 'other' ELSE 'en' END AS predicted
  FROM labelled
)"""


#: Guesses whose label is given within an hour.
LABELLED_GUESSES = GUESSES.replace("FROM labelled", "FROM labelled WHERE row_id % 90 <= 60")

#: The raw rows in their order of arrival.
ARRIVING = CLEAN + """,
arriving AS (SELECT *, CASE row_id % 5 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS arrival FROM nonempty)"""


def report_ctes(rows="rows_", prefix=""):
    """CTE `classes`: precision, recall, f1 and support per label, by definition from the rows."""
    p = prefix
    return f"""
{p}names AS (SELECT actual AS label FROM {rows} UNION SELECT predicted FROM {rows}),
{p}tally AS (
  SELECT label,
    (SELECT count(*) FROM {rows} WHERE actual = label AND predicted = label) AS tp,
    (SELECT count(*) FROM {rows} WHERE predicted = label) AS guessed,
    (SELECT count(*) FROM {rows} WHERE actual = label) AS support
  FROM {p}names
),
{p}classes AS (
  SELECT label, coalesce(tp / nullif(guessed, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(guessed + support, 0), 0) AS f1, support FROM {p}tally
)"""


def full_report(ctes):
    return f"""WITH {ctes}, {report_ctes()}
SELECT 0 AS position, label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM classes
UNION ALL SELECT 1, 'accuracy', NULL, NULL, round((SELECT avg((actual = predicted)::INT) FROM rows_), 4), (SELECT count(*) FROM rows_)
UNION ALL SELECT 2, 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM classes
UNION ALL SELECT 3, 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM classes"""


def summary(rows, prefix):
    return (
        f"(SELECT avg((actual = predicted)::INT) FROM {rows}) AS accuracy, (SELECT avg(f1) FROM {prefix}classes) AS macro_f1, "
        f"(SELECT sum(f1 * support) / sum(support) FROM {prefix}classes) AS weighted_f1"
    )


EXPERIMENT_GUESSES = {
    "tfidf_only": "type",
    "by_scheme": "CASE WHEN starts_with(url, 'https://') THEN 'en' ELSE 'fr' END",
    "by_query": "CASE WHEN contains(url, '?') THEN 'de' ELSE 'en' END",
}


def experiments_ctes():
    ctes, rows = PAGES, []
    for i, (name, guess) in enumerate(EXPERIMENT_GUESSES.items()):
        ctes += f", r{i} AS (SELECT type AS actual, {guess} AS predicted FROM labelled), {report_ctes(f'r{i}', f'x{i}_')}"
        rows.append(f"SELECT {i} AS position, '{name}' AS experiment, {summary(f'r{i}', f'x{i}_')}")
    return f"{ctes}, results AS ({' UNION ALL '.join(rows)})"


ROUNDED = "position, experiment, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1"
LEXICAL = f"WITH {PAGE_URLS}, {parts('urls')}"
SPLIT_LIST = "page_id, subdomain, domain, suffix, registered_domain"
ALL_BUT_REDUNDANT = [c for c in LEXICAL_FEATURES if c not in LEXICAL_GROUPS["redundant"]]
LEXICAL_ONLY = [c for c in LEXICAL_FEATURES if c not in DOMAIN_FEATURES]


def standardized():
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LEXICAL_FEATURES)
    scaled = ", ".join(
        f"round(CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END, 5) AS {c}" for c in LEXICAL_FEATURES
    )
    return f"""WITH {PAGE_SPLIT}, {parts('split')},
features AS (SELECT row_id, split, {lexical_list()} FROM hosts),
stats AS (SELECT {stats} FROM features WHERE split = 'train')
SELECT row_id, split, {scaled} FROM features, stats"""


ORACLES = {
    "lexical_features": f"{LEXICAL} SELECT page_id, {lexical_list()} FROM hosts",
    "lexical_features_decorated": f"WITH {DECORATED}, {parts('decorated')} SELECT row_id, {lexical_list()} FROM hosts",
    "lexical_by_host": f"{LEXICAL}, f AS (SELECT host, {lexical_list()} FROM hosts) SELECT host, count(*) AS n_urls, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in LEXICAL_FEATURES) + " FROM f GROUP BY host",
    "url_parts": f"WITH {DECORATED}, {parts('decorated')} SELECT row_id, scheme, host, path, query, fragment, has_port, has_ip FROM hosts",
    "feature_selection": f"{LEXICAL} SELECT page_id, {lexical_list(ALL_BUT_REDUNDANT)} FROM hosts",
    "na_tokens": f"WITH {CLEAN} SELECT count(*) AS n_rows, count(url) AS n_url, count(type) AS n_type FROM tokens",
    "normalize_urls": f"WITH {RAW} SELECT row_id, {normalized('url')} AS url FROM raw",
    "clean_urls": f"WITH {CLEAN} SELECT * FROM clean",
    "duplicates_removed": f"WITH {CLEAN} SELECT count(*) AS rows_before, count(DISTINCT url) AS rows_after, "
    "count(*) - count(DISTINCT url) AS removed FROM nonempty",
    "class_distribution": f"WITH {CLEAN} SELECT type, count(*) AS n FROM clean GROUP BY type",
    "class_percentages": f"WITH {CLEAN} SELECT type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent "
    "FROM clean GROUP BY type",
    "distinct_labels": f"WITH {CLEAN} SELECT DISTINCT type FROM clean",
    "dataset_profile": f"WITH {RAW} SELECT 'rows' AS metric, 'all' AS item, count(*) AS n FROM raw UNION ALL SELECT 'columns', 'all', 3 "
    "UNION ALL SELECT 'label', type, count(*) FROM raw GROUP BY type",
    "preview_head": f"WITH {CLEAN} SELECT * FROM clean ORDER BY row_id LIMIT 5",
    "csv_line_breaks": "SELECT page_id, url, length(html) AS n_chars, md5(html) AS html_md5 "
    "FROM (SELECT page_id, url, replace(html, '>', '>' || chr(10)) AS html FROM pages)",
    "csv_source": f"WITH {CLEAN} SELECT * FROM clean",
    "domain_split": domain_query(PAGE_URLS, "urls", RULES, SPLIT_LIST),
    "domain_split_deep_rules": domain_query(PAGE_URLS, "urls", DEEP_RULES, SPLIT_LIST),
    "domain_features": domain_query(PAGE_URLS, "urls", DEEP_RULES, f"page_id, {domain_list()}"),
    "domain_features_decorated": domain_query(DECORATED, "decorated", RULES, f"row_id, {domain_list()}"),
    "domain_features_special": domain_query(SPECIAL, "special", SPECIAL_RULES, f"row_id, {domain_list()}"),
    "high_entropy_domains": f"SELECT * FROM ({domain_query(PAGE_URLS, 'urls', DEEP_RULES, 'domain, count(*) AS n_urls, round(coalesce(any_value(entropy), 0), 4) AS entropy')} "
    "GROUP BY domain) WHERE entropy > 2.5",
    "combined_features": domain_query(PAGE_URLS, "urls", RULES, f"page_id, {lexical_list(LEXICAL_ONLY)}, {domain_list()}"),
    "text_entropy": "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), "
    "f AS (SELECT doc_id, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM c GROUP BY doc_id, ch), "
    "e AS (SELECT doc_id, -sum(n / total * log2(n / total)) AS entropy FROM f GROUP BY doc_id) "
    "SELECT doc_id, round(coalesce(entropy, 0), 4) AS entropy FROM documents LEFT JOIN e USING (doc_id)",
    "char_ngrams": f"WITH {grams('pages', 'page_id', 'url')} SELECT id AS page_id, gram, tf FROM terms",
    "document_ngrams": f"WITH {grams('documents', 'doc_id', 'text')} SELECT id AS doc_id, count(*) AS n_grams, "
    "sum(tf)::BIGINT AS n_occurrences, max(tf) AS max_tf FROM terms GROUP BY id",
    "vocabulary": f"WITH {grams('pages', 'page_id', 'url')}, {fitted('pages', 'terms')} SELECT gram, df, total, round(idf, 6) AS idf FROM vocab",
    "vocabulary_capped": f"WITH {grams('pages', 'page_id', 'url')}, {fitted('pages', 'terms', 500)} SELECT gram, df, total, round(idf, 6) AS idf FROM vocab",
    "document_vocabulary": f"WITH {grams('documents', 'doc_id', 'text')}, {fitted('documents', 'terms')} "
    "SELECT gram, df, total, round(idf, 6) AS idf FROM vocab",
    "char_tfidf": f"WITH {grams('pages', 'page_id', 'url')}, {fitted('pages', 'terms')}, {weighted('terms')} "
    "SELECT id AS page_id, gram, tf, round(tfidf, 6) AS tfidf FROM unit",
    "document_tfidf": f"WITH {grams('documents', 'doc_id', 'text')}, {fitted('documents', 'terms')}, {weighted('terms')} "
    "SELECT id AS doc_id, count(*) AS n_known, round(sum(tfidf), 4) AS sum_tfidf, round(max(tfidf), 6) AS max_tfidf FROM unit GROUP BY id",
    "tfidf_train_test": f"WITH {PAGE_SPLIT}, {grams('train', 'row_id', 'url')}, {fitted('train', 'terms')}, "
    f"{grams('test', 'row_id', 'url', 'test_terms')}, {weighted('test_terms')} SELECT id AS row_id, gram, round(tfidf, 6) AS tfidf FROM unit",
    "tfidf_shapes": f"WITH {PAGE_SPLIT}, {grams('train', 'row_id', 'url')}, {fitted('train', 'terms')} "
    "SELECT split, count(*) AS n_rows, (SELECT count(*) FROM vocab) AS n_features FROM split GROUP BY split",
    "uniform_sample": f"WITH {PAGES} SELECT * FROM labelled ORDER BY md5('42:' || url), url LIMIT 40",
    "stratified_sample": f"WITH {PAGES}, {quota_ctes('labelled', 'type', '40::HUGEINT')} SELECT row_id, url, type FROM marked WHERE inside",
    "stratified_split": f"WITH {CLEAN}, {quota_ctes('clean', 'type', TRAIN_SIZE)} "
    "SELECT row_id, url, type, CASE WHEN inside THEN 'train' ELSE 'test' END AS split FROM marked",
    "standardized_features": standardized(),
    "class_weights": f"WITH {CLEAN}, c AS (SELECT type, count(*) AS n FROM clean GROUP BY type) "
    "SELECT type, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c",
    "weighted_rows": f"WITH {PAGES}, c AS (SELECT type, count(*) AS n FROM labelled GROUP BY type) "
    "SELECT row_id, type, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM labelled JOIN c USING (type)",
    "confusion_matrix": f"WITH {GUESSES}, l AS (SELECT DISTINCT actual AS label FROM rows_) SELECT a.label AS actual, p.label AS predicted, "
    "(SELECT count(*) FROM rows_ WHERE actual = a.label AND predicted = p.label) AS n FROM l a, l p",
    "confusion_table": f"WITH {GUESSES} SELECT actual, "
    + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM rows_ GROUP BY actual",
    "classification_report": full_report(GUESSES),
    "summary_metrics": f"WITH {GUESSES}, {report_ctes()}, s AS (SELECT {summary('rows_', '')}) "
    "SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM s",
    "document_label_metrics": full_report(
        "rows_ AS (SELECT quality::VARCHAR AS actual, (n_chars >= 1000)::INT::VARCHAR AS predicted FROM labels JOIN documents USING (doc_id))"
    ),
    "experiment_summary": f"WITH {experiments_ctes()} SELECT {ROUNDED} FROM results",
    "best_experiment": f"WITH {experiments_ctes()} SELECT {ROUNDED} FROM results ORDER BY results.macro_f1 DESC, position LIMIT 1",
    "best_hybrid_experiment": f"WITH {experiments_ctes()} SELECT {ROUNDED} FROM results WHERE experiment <> 'tfidf_only' "
    "ORDER BY results.macro_f1 DESC, position LIMIT 1",
    "metrics_csv_sink": f"WITH {experiments_ctes()} SELECT {ROUNDED} FROM results",
    "stream_first_labels": f"WITH {ARRIVING} SELECT row_id, url, type FROM arriving "
    "QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival, row_id) = 1",
    # two-day periods count from 1970-01-01: the first arrival falls into one, the second and third into the next, the repeats into one more
    "stream_first_labels_by_period": f"WITH {ARRIVING}, again AS (SELECT row_id, arrival, url, type FROM arriving UNION ALL SELECT row_id, 3, "
    "CASE WHEN starts_with(trim(url, ' ' || chr(9)), 'http') THEN url ELSE 'http://' || trim(url, ' ' || chr(9)) END, 'late' FROM raw "
    "WHERE url <> 'N/A' AND trim(url) <> '') SELECT row_id, url, type FROM again "
    "QUALIFY row_number() OVER (PARTITION BY url, (19723 + arrival) // 2 ORDER BY arrival, row_id) = 1",
    "stream_late_labels": full_report(LABELLED_GUESSES),
    "stream_features": f"{LEXICAL} SELECT page_id, {lexical_list()} FROM hosts",
    "stream_domain_features": domain_query(PAGE_URLS, "urls", DEEP_RULES, f"page_id, {domain_list()}"),
    # The class is written in the URL: whatever the solver, a right text model predicts it for every row.
    "text_predictions_checked": f"WITH {PAGES} SELECT row_id, type AS prediction FROM labelled",
    "stream_predictions_checked": f"WITH {PAGES} SELECT row_id AS page_id, type AS prediction FROM labelled",
    "ablation_checked": f"WITH {PAGE_SPLIT} SELECT type, count(*) AS n_test, count(*) AS n_right, experiment "
    "FROM test, (SELECT unnest(['v4_tfidf_only', 'v4_tfidf_v3', 'v4_tfidf_domain', 'v4_tfidf_v3_domain']) AS experiment) "
    "GROUP BY type, experiment",
    "ablation_resumed_checked": f"WITH {PAGE_SPLIT} SELECT type, experiment, count(*) AS n_test, count(*) AS n_right, true AS kept "
    "FROM test, (SELECT unnest(['v4_tfidf_only', 'v4_tfidf_domain']) AS experiment) GROUP BY type, experiment",
    "forest_checked": f"WITH {PAGES}, k AS (SELECT count(DISTINCT type) AS n FROM labelled) "
    "SELECT row_id, type, n AS n_classes, n::INT AS last_rank, 1.0::DOUBLE AS total, true AS agrees FROM labelled, k",
    "certificate_checked": f"WITH {PAGES} SELECT DISTINCT type AS class, true AS optimal FROM labelled",
    "forest_importance_checked": f"SELECT unnest([{quoted(LEXICAL_FEATURES)}]) AS feature, true AS agrees, feature = 'url_length' AS most",
    "forest_walk_checked": "SELECT page_id AS row_id, true AS agrees FROM pages",
    "forest_given_checked": f"""{LEXICAL}, f AS (SELECT page_id AS row_id, {lexical_list()} FROM hosts),
first AS (SELECT row_id, CASE WHEN url_length > 60 THEN 0.1 WHEN num_digits <= 2 THEN 0.8 ELSE 0.3 END AS a,
  CASE WHEN path_length <= 20 THEN 0.75 WHEN query_length <= 0 THEN 0.4 ELSE 0.05 END AS b FROM f)
SELECT row_id, round(((a + b) / 2)::DOUBLE, 6) AS share_0, round((1 - (a + b) / 2)::DOUBLE, 6) AS share_1 FROM first""",
    "learned_checked": f"""WITH {PADDED} SELECT experiment, (SELECT count(*) FROM padded WHERE flipped <> (length(url) > 85)) AS n_long,
experiment IN ('tfidf_length', 'forest') AS learned FROM (SELECT unnest(['tfidf_only', 'tfidf_length', 'tfidf_suspicious', 'forest']) AS experiment)""",
}
