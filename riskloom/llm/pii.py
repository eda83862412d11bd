"""Personal data: patterns, and information-theoretic sanitisation of what reveals them.

Protected entities are the values that the base patterns find (an e-mail address, an IP address, a card or phone
number). How strongly a term t reveals an entity e is estimated from the whole corpus: PMI(t; e) as a share of e's
information content, 1 + log p(e|t) / -log p(e), with probabilities over documents. At `REMOVE` (1: the term never occurs without
the entity) the term discloses it fully and is to be removed; from `GENERALISE` on it is replaced by its shape. Pairs
seen in fewer than `SUPPORT` documents are no evidence, so entities below it are left out first.

Base spans stay as they are; disclosing terms are added spans (`reveal`: remove, `hint`: generalise) where they overlap no
base span. Whole texts, code points, end exclusive; null text counts as empty. Rows are told apart by id and text, so repeated
rows agree; rows without an id are treated like others.

Terms, in lower case, are runs of two letters or more, and runs of letters and digits that hold both; a run that is no disclosing
term as a whole may hold one. Single letters and bare numbers are no terms. Counts are pre-aggregated in map tasks; tables that are joined are measured and
broadcast only when small. No step gathers the rows of an entity or a term.
"""

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_schema, documents, id_and_text, map_batches, prepare_python, run_before, sized_join, stage_table
from .secret_scan import count_kind

#: Fixed by the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The contract's pattern, tried once per run of digits: where it fails at a run's first digit, it fails at the others too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]
ADDED = ["reveal", "hint"]
SUPPORT, REMOVE, GENERALISE = 3, 1.0 - 1e-9, 0.9

_DIGIT = re.compile("[0-9]")
_RUN, _LETTERS = regex.compile(r"[\p{L}\p{Nd}]+"), regex.compile(r"\p{L}{2,}")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")  # Python refuses to convert thousands of digits, zeros too
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str):
    """Leftmost non-overlapping matches, tried only at the runs that end in an @."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = run_before(text, at, end, _LOCAL)
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple]:
    """(kind, start, end), by kind in the contract's order, then by start."""
    found = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(is_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


FOUND = "doc_id long,mark long,kinds array<string>,starts array<long>,ends array<long>,entities array<string>"


def find_base(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, spans, entities) per row of (doc_id, text, mark)."""

    def work(batch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        spans = [base_spans(t) for t in texts]
        return {"doc_id": batch.column(0), "mark": batch.column(2), "kinds": [[x[0] for x in s] for s in spans],
                "starts": [[x[1] for x in s] for s in spans], "ends": [[x[2] for x in s] for s in spans],
                "entities": [sorted({entity(k, t[a:b]) for k, a, b in s}) for t, s in zip(texts, spans)]}

    return map_batches(rows, work, FOUND)


def terms_of(text):
    """Column: distinct lower-case terms."""
    letters = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 2)
    mixed = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{Nd}])(?:\p{L}++\p{Nd}|\p{Nd}++\p{L})[\p{L}\p{Nd}]*+"), 0)
    return F.array_distinct(F.transform(F.concat(letters, mixed), F.lower))


def disclosing_terms(rows: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term_key, strength): terms whose PMI with some protected entity is at least `generalise` of its information.

    `rows` is (doc_id, text, mark), `found` the staged result of `find_base`. One count of all terms of all documents, and one of the pairs
    in documents that hold an entity of `support` documents or more.
    """
    total = found.count()
    held = found.filter(F.size("entities") > 0).select("doc_id", "mark", F.explode("entities").alias("entity"))
    entities = stage_table(held.groupBy("entity").agg(F.count("*").alias("entity_df")).filter(F.col("entity_df") >= support), "entities")
    kept = sized_join(held, entities, "entity", "inner").select("doc_id", "mark", "entity", "entity_df")
    by_row = kept.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("entity", "entity_df")).alias("held"))  # entities of one text
    by_row = stage_table(by_row.select(F.col("doc_id").alias("held_id"), F.col("mark").alias("held_mark"), "held"), "holders")
    same = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("mark") == F.col("held_mark"))
    pairs = sized_join(rows, by_row, same, "inner").select("held", F.explode(terms_of(F.col("text"))).alias("term")).select(
        F.xxhash64("term").alias("term_key"), F.explode("held").alias("e"))
    pairs = pairs.groupBy("term_key", "e.entity", "e.entity_df").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    pairs = stage_table(pairs, "pairs")
    every = rows.select(F.explode(terms_of(F.col("text"))).alias("term")).select(F.xxhash64("term").alias("term_key"))
    counts = every.groupBy("term_key").agg(F.count("*").alias("term_df"))
    information = -F.log(F.col("entity_df") / F.lit(float(total)))
    strength = F.when(information > 0, 1 + F.log(F.col("both") / F.col("term_df")) / information).otherwise(0.0)
    scored = pairs.join(counts, "term_key").select("term_key", strength.alias("strength"))
    return scored.filter(F.col("strength") >= generalise).groupBy("term_key").agg(F.max("strength").alias("strength"))


ADDED_SCHEMA = "doc_id long,mark long,added_kinds array<string>,added_starts array<long>,added_ends array<long>"


def term_spans(text: str, kinds: dict[str, str], taken: list[tuple]) -> list[tuple]:
    """(kind, start, end) of the terms in `kinds`, where they overlap none of the (start, end) taken."""
    def free(m):
        return not any(a < m.end() and m.start() < b for a, b in taken)

    out = []
    for run in _RUN.finditer(text):
        whole = [run] if run[0].lower() in kinds and free(run) else _LETTERS.finditer(text, *run.span())
        out += [(kinds[m[0].lower()], *m.span()) for m in whole if m[0].lower() in kinds and free(m)]
    return out


def added_spans(rows: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, mark, added spans) of the rows that hold a disclosing term."""
    kind = F.when(F.col("strength") >= REMOVE, ADDED[0]).otherwise(ADDED[1]).alias("kind")
    terms = stage_table(terms.select("term_key", kind), "terms")
    words = rows.select("doc_id", "mark", F.explode(terms_of(F.col("text"))).alias("term")).withColumn("term_key", F.xxhash64("term"))
    hits = sized_join(words, terms, "term_key", "inner").groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("term", "kind")).alias("terms"))  # at most the words of one text
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), F.to_json("terms").alias("terms"))
    hits = stage_table(hits, "hits")
    spans = stage_table(found.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "starts", "ends").distinct(), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark"))
    some = hits.alias("h").join(spans.alias("s"), F.col("h.hit_id").eqNullSafe(F.col("s.hit_id")) & (F.col("h.hit_mark") == F.col("s.hit_mark"))).select(
        "h.hit_id", "h.hit_mark", "h.terms", "s.starts", "s.ends")
    some = stage_table(some, "sought")
    joined = sized_join(rows, some, same, "inner").select("doc_id", "mark", "text", "terms", "starts", "ends")

    def work(batch):
        import json

        out = []
        for text, terms, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            out.append(term_spans(text, {x["term"]: x["kind"] for x in json.loads(terms)}, list(zip(starts, ends))))
        return {"doc_id": batch.column(0), "mark": batch.column(1), **{
            f"added_{name}": [[s[i] for s in x] for x in out] for i, name in enumerate(("kinds", "starts", "ends"))}}

    return map_batches(joined, work, ADDED_SCHEMA).dropDuplicates(["doc_id", "mark"])  # repeated rows have equal spans


def find_personal(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, kinds, starts, ends, added_kinds, added_starts, added_ends) for every row of df."""
    rows = id_and_text(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    found = stage_table(find_base(rows), "base")
    terms = disclosing_terms(rows.filter(F.col("text").isNotNull()), found)
    added = stage_table(added_spans(rows.filter(F.col("text").isNotNull()), found, terms), "added").select(
        F.col("doc_id").alias("added_id"), F.col("mark").alias("added_mark"), "added_kinds", "added_starts", "added_ends")
    same = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("mark") == F.col("added_mark"))
    return sized_join(found, added, same, "left").select("doc_id", "kinds", "starts", "ends", "added_kinds", "added_starts", "added_ends")


def sanitise(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text): base values become `[kind]`, removed terms `[...]`, generalised ones their shape (`Aaa`)."""
    spans = find_personal(df, id_col, text_col)
    rows = id_and_text(df, id_col, text_col)
    joined = rows.join(spans.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "span_id"), F.col("doc_id").eqNullSafe(F.col("span_id")), "left")
    schema = arrow_schema("doc_id long,text string")
    prepare_python(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text, *columns in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                a, b = [list(zip(*(x or [] for x in columns[i:i + 3]))) for i in (0, 3)]
                parts, end = [], 0
                for kind, start, stop in sorted(a + b, key=lambda s: s[1:]):
                    if start >= end:
                        word = text[start:stop]
                        shape = re.sub("[^A-Z]", "a", re.sub("[A-Z]", "A", word))
                        parts += [text[end:start], f"[{kind}]" if kind in KINDS else "[...]" if kind == ADDED[0] else shape]
                        end = stop
                out.append(None if text is None else "".join(parts) + text[end:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=schema)

    return joined.select("doc_id", "text", "kinds", "starts", "ends", "added_kinds", "added_starts", "added_ends").mapInArrow(run, "doc_id long, text string")


def spans_column(prefix: str = ""):
    rows = F.arrays_zip(*(F.coalesce(f"{prefix}{c}", F.array()).alias(c) for c in ("kinds", "starts", "ends")))
    return F.transform(rows, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))


def of_kind(spans, kind: str):
    return F.filter(spans, lambda s: s.startswith(f"{kind}:"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6."""
    found = find_personal(documents(spark, sf_dir))
    base, added = spans_column(), spans_column("added_")
    ordered = F.concat(base, *[of_kind(added, kind) for kind in ADDED])  # by kind, then by start
    return found.select("doc_id", *map(count_kind, KINDS), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(ordered, ",").alias("spans"))
