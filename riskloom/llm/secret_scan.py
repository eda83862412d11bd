"""Secret scans over an inverted index of trigrams.

From each rule's regular expression a Boolean query of trigrams is derived: every match must contain them. Each batch
of documents is a segment with its own inverted index (trigram -> posting list of documents) over the trigrams that the rules ask
for, folded to lower case (a posting that no rule can read is not kept). Posting lists are intersected and united by
the query, only candidates are verified with the regular expression, and rules without a mandatory trigram scan every
document. Segments are independent, so a scan is one map over the input: no shuffle, no key that could be hot.

Whole texts are scanned; null text counts as empty. Offsets are code points, end exclusive. Base kinds first, in the
contract's order, then the added kinds.
"""

import re
from re import _constants as op, _parser as parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, id_and_text, map_batches, run_before

#: Bytes of a segment: the temporary arrays of an index are a small multiple of it.
SEGMENT_BYTES = 4 << 20


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed by the contract: kind, pattern, and what a match must satisfy besides.
KEYWORDS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
BASE_RULES = [
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: m.end(2) - m.start(2) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 16),
    ("hex", r"[0-9a-f]{32,}", None),  # maximal runs, as those of [0-9a-f]+ with 32 characters or more are
]
#: Added by this operator: well-known public token shapes.
MORE_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", None),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None),
    ("google", r"AIza[A-Za-z0-9_-]{35}", None),
]
RULES = BASE_RULES + MORE_RULES
#: More spellings than this of a stretch end it: the query gets weaker, never wrong.
SPELLINGS = 64


def trigram_query(pattern: str):
    """Boolean query of folded trigrams that every match satisfies: a trigram (bytes), ("and", ...), ("or", ...) or True."""
    return _sequence(parser.parse(pattern))


def _grams(text: str):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    return _all([raw[i:i + 3] for i in range(len(raw) - 2)])


def _all(queries):
    flat = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _any(queries):
    flat = list(dict.fromkeys(queries))
    return True if True in flat or not flat else flat[0] if len(flat) == 1 else ("or", *flat)


def _fold(c: int) -> str:
    return chr(c + 32) if 65 <= c <= 90 else chr(c)


def _exact(item):
    """All (folded) spellings of an item, or None if they are many or unknown."""
    code, arg = item
    if code is op.LITERAL:
        return [_fold(arg)]
    if code is op.IN and all(k is op.LITERAL for k, _ in arg):
        return sorted({_fold(c) for _, c in arg})
    if code is op.SUBPATTERN and not arg[1] and not arg[2]:
        return _spellings(arg[3])
    if code is op.BRANCH:
        every = [_spellings(x) for x in arg[1]]
        return None if None in every else sorted({y for x in every for y in x})
    if code is op.MAX_REPEAT and arg[1] <= 2:
        one = _spellings(arg[2])
        if one is None:
            return None
        out, now = [], [""]
        for n in range(int(arg[1]) + 1):
            out += now if n >= arg[0] else []
            now = [a + b for a in now for b in one]
        return sorted(set(out)) if len(out) <= SPELLINGS else None
    return None


def _spellings(sequence):
    out = [""]
    for item in sequence:
        one = _exact(item)
        if one is None or len(out) * len(one) > SPELLINGS:
            return None
        out = [a + b for a in out for b in one]
    return out


def _sequence(sequence):
    found, run = [], [""]

    def flush():
        found.append(_any([_grams(x) for x in run]))

    for item in sequence:
        one = _exact(item)
        if one is not None and len(run) * len(one) <= SPELLINGS:
            run = [a + b for a in run for b in one]
            continue
        flush()
        run = one if one is not None else [""]
        code, arg = item
        if one is None:
            if code is op.SUBPATTERN:
                found.append(_sequence(arg[3]))
            elif code is op.BRANCH:
                found.append(_any([_sequence(x) for x in arg[1]]))
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
                found.append(_sequence(arg[2]))
    flush()
    return _all(found)


def trigrams_of(query) -> set:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1:]))


class Segment:
    """Inverted index of a run of texts: trigram -> ascending array of the texts' numbers."""

    def __init__(self, texts: list[bytes], trigrams):
        self.n = len(texts)
        trigrams = sorted(trigrams)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts])
        raw = np.frombuffer(b"\0\0".join([*texts, b""]), np.uint8)  # no trigram asked for holds a zero byte
        raw = _FOLD[raw]
        code = raw[:-2].astype(np.uint32) << 16
        code |= raw[1:-1].astype(np.uint32) << 8
        code |= raw[2:]
        wanted = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(trigrams, 1):
            wanted[t[0] << 16 | t[1] << 8 | t[2]] = i
        hit = wanted[code]
        at = np.flatnonzero(hit)
        pairs = np.unique(hit[at].astype(np.int64) << 32 | np.searchsorted(starts, at, "right") - 1)
        cuts = np.searchsorted(pairs, np.arange(1, len(trigrams) + 2) << 32)
        self.postings = {t: pairs[cuts[i]:cuts[i + 1]] & 0xFFFFFFFF for i, t in enumerate(trigrams)}

    def find(self, query) -> np.ndarray:
        """Numbers of the texts that satisfy a query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted((self.find(q) for q in query[1:]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        out = lists[0]
        for x in lists[1:]:
            out = out[np.isin(out, x, assume_unique=True)]
        return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


_JWT, _JWT_RUN = re.compile(next(p for k, p, _ in MORE_RULES if k == "jwt")), re.compile("[A-Za-z0-9_-]*")


def web_tokens(text: str):
    """The matches of the jwt rule, tried only at the first place of each run before a `.eyJ`: where that fails, later ones in the run fail too."""
    at, end = text.find(".eyJ"), 0
    while at >= 0:
        start = text.find("eyJ", run_before(text, at, end, _JWT_RUN), at)
        m = _JWT.match(text, start) if start >= 0 else None
        if m:
            yield m
            end = m.end()
        at = text.find(".eyJ", max(at + 1, end))


#: Finders that give the matches of a rule's pattern in time proportional to the text, where the pattern itself would not.
FINDERS = {_JWT.pattern: web_tokens}


def scan_segment(texts: list[str], rules, queries) -> list[list[tuple]]:
    """Per text its spans (kind, start, end), by start, then in the order of the rules."""
    index = Segment([t.encode() for t in texts], set().union(*map(trigrams_of, queries)))
    found = [[] for _ in texts]
    for place, ((kind, pattern, holds), query) in enumerate(zip(rules, queries)):
        search = FINDERS.get(pattern) or re.compile(pattern).finditer
        for i in index.find(query).tolist():
            found[i] += [(m.start(), place, kind, m.end()) for m in search(texts[i]) if holds is None or holds(m)]
    return [[(kind, a, b) for a, _, kind, b in sorted(x)] for x in found]


def find_secrets(df: DataFrame, id_col="doc_id", text_col="text", rules=None) -> DataFrame:
    """(doc_id, kinds, starts, ends): per row of df the spans found in its whole text, as parallel arrays."""
    rules = RULES if rules is None else rules
    queries = [trigram_query(pattern) for _, pattern, _ in rules]

    def work(batch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        spans, run, size = [], [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= SEGMENT_BYTES:
                spans += scan_segment(run, rules, queries)
                run, size = [], 0
        spans += scan_segment(run, rules, queries) if run else []
        return {"doc_id": batch.column(0), "kinds": [[x[0] for x in s] for s in spans],
                "starts": [[x[1] for x in s] for s in spans], "ends": [[x[2] for x in s] for s in spans]}

    return map_batches(id_and_text(df, id_col, text_col), work, "doc_id long,kinds array<string>,starts array<long>,ends array<long>")


def span_list(kinds=None):
    """Column: kind:start:end joined by commas, of all spans or of some kinds."""
    rows = F.arrays_zip("kinds", "starts", "ends")
    if kinds:
        rows = F.filter(rows, lambda s: s["kinds"].isin(kinds))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")


def count_kind(kind: str):
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3."""
    base = [kind for kind, _, _ in BASE_RULES]
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", *map(count_kind, base), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list().alias("spans"))
