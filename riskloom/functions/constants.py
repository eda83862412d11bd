"""Word lists, column names, character sets, patterns and thresholds.

Everything in this file is data that must have exactly these values for the
results to be right. There is no logic here except joining patterns together.
"""

# Words whose presence in a lower-cased URL is counted.
SUSPICIOUS_WORDS = [
    "login", "signin", "verify", "verification", "secure", "security", "account",
    "update", "password", "passwd", "confirm", "confirmation", "bank", "paypal",
    "wallet", "auth", "authenticate", "credential", "recover", "reset", "unlock",
]

# The 25 lexical feature names in output order.
LEXICAL_FEATURES = [
    "url_length", "hostname_length", "path_length", "query_length",
    "num_dots", "num_slashes", "num_hyphens", "num_underscores", "num_digits",
    "num_special_chars", "num_at", "num_question", "num_equal", "num_ampersand",
    "num_percent", "num_colons", "num_semicolons",
    "has_https", "has_ip", "num_subdomains",
    "has_suspicious_word", "num_suspicious_words",
    "has_double_slash", "has_encoded_characters", "has_port",
]

# Named groups of lexical features.
LEXICAL_GROUPS = {
    "length": ["url_length", "hostname_length", "path_length", "query_length"],
    "structural": [
        "num_dots", "num_slashes", "num_hyphens", "num_underscores", "num_digits",
        "num_special_chars", "num_at", "num_question", "num_equal", "num_ampersand",
        "num_percent", "num_colons", "num_semicolons", "has_https", "has_ip",
        "num_subdomains", "has_double_slash", "has_encoded_characters", "has_port",
    ],
    "suspicious": ["has_suspicious_word", "num_suspicious_words"],
    "redundant": ["has_suspicious_word", "has_encoded_characters"],
}

# The 16 registered-domain feature names in output order.
DOMAIN_FEATURES = [
    "registered_domain_length", "domain_length", "tld_length", "subdomain_length",
    "num_subdomains", "num_domain_labels",
    "domain_num_digits", "domain_num_hyphens", "domain_num_special_chars",
    "domain_digit_ratio", "domain_hyphens_ratio", "domain_entropy",
    "is_punycode", "has_long_subdomain", "is_numeric_tld", "high_domain_entropy",
]

# Named groups of domain features.
DOMAIN_GROUPS = {
    "identity": [
        "registered_domain_length", "domain_length", "tld_length",
        "subdomain_length", "num_subdomains", "num_domain_labels",
    ],
    "composition": [
        "domain_num_digits", "domain_num_hyphens", "domain_num_special_chars",
        "domain_digit_ratio", "domain_hyphens_ratio", "domain_entropy",
    ],
    "suspicion": ["is_punycode", "has_long_subdomain", "is_numeric_tld", "high_domain_entropy"],
}

# Thresholds, seeds and model settings.
HIGH_ENTROPY_THRESHOLD = 4.0
LONG_SUBDOMAIN_THRESHOLD = 3
RANDOM_SEED = 42
TEST_FRACTION = 0.2
FOREST_TREES = 200
NGRAM_MIN, NGRAM_MAX = 3, 5
MIN_DF, MAX_DF = 2, 0.95
MAX_FEATURES = 500_000
LOGISTIC_C = 4.0
LOGISTIC_MAX_ITER = 1000
LOGISTIC_TOLERANCE = 1e-4

# CSV tokens that mean "missing" (the documented pandas defaults).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Unicode white space, as Python's str.strip() removes it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Characters that are digits (str.isdigit) without being category Nd.
EXTRA_DIGITS = (
    r"\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
    r"\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}"
    r"\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}"
    r"\x{1f100}-\x{1f10a}"
)
DIGIT_CLASS = r"[\p{Nd}" + EXTRA_DIGITS + "]"

# Characters whose compatibility form contains one of / ? # @ :
# Such a character makes an authority malformed.
SPLITTING_CHARS = (
    r"[\x{2047}-\x{2049}\x{2100}-\x{2101}\x{2105}-\x{2106}\x{2a74}\x{fe13}\x{fe16}"
    r"\x{fe55}-\x{fe56}\x{fe5f}\x{fe6b}\x{ff03}\x{ff0f}\x{ff1a}\x{ff1f}-\x{ff20}]"
)

# Dots that separate host labels, besides the ASCII one.
OTHER_DOTS = "。．｡"

# Fixed patterns: IP literals, ports, and the IPvFuture form allowed in brackets.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = _OCTET + "([.]" + _OCTET + "){3}"
_H16 = "[0-9A-Fa-f]{1,4}"


def _ipv6():
    forms = [f"({_H16}:){{7}}{_H16}", f"({_H16}:){{6}}{IPV4}", "::"]
    for left in range(8):
        groups = ":".join([_H16] * left)
        if left < 7:
            forms.append(f"{groups}::({_H16}:){{0,{6 - left}}}{_H16}")
        if left <= 5:
            forms.append(f"{groups}::({_H16}:){{0,{5 - left}}}{IPV4}")
        if left > 0:
            forms.append(f"{groups}::")
    return "(" + "|".join(forms) + ")(%[^%]+)?"


IPV6 = _ipv6()
IPV_FUTURE = r"v[a-fA-F0-9]+\..+"
PORT = "0*([0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
