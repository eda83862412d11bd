import math
import random
import re
from collections import Counter

from riskloom.operators.tfidf import (
    char_terms, document_frequencies, fit_tfidf, gram_array, gram_entries, gram_frequencies, most_frequent,
)


def brute_counts(text):
    text = re.sub(r"\s\s+", " ", text.lower())
    return Counter(text[i:i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1))


def texts(n=25):
    rng = random.Random(3)
    alphabet = list("abAB  \t.é😀1")
    return {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for i in range(n)}


def test_worked_example(spark):
    df = spark.createDataFrame([(1, "aab"), (2, "aabc"), (3, "xabc")], "id long, s string")
    model = fit_tfidf(df, "id", "s")
    assert {r["gram"]: round(r["idf"], 6) for r in model.vocabulary.collect()} == {"aab": 1.287682, "abc": 1.287682}
    got = {(r["id"], r["gram"]): round(r["tfidf"], 6) for r in model.transform(df, "id", "s").collect()}
    assert got == {(1, "aab"): 1.0, (2, "aab"): 0.707107, (2, "abc"): 0.707107, (3, "abc"): 1.0}


def test_terms_match_brute_force_for_every_chunk_size(spark):
    data = texts()
    df = spark.createDataFrame(list(data.items()), "id long, s string")
    want = {(i, g): n for i, t in data.items() for g, n in brute_counts(t).items()}
    for chunk in (1, 4, 7, 1 << 16):
        got = {(r["id"], r["gram"]): r["tf"] for r in char_terms(df, "id", "s", chunk=chunk).collect()}
        assert got == want, chunk


def test_gram_array(spark):
    df = spark.createDataFrame([("ab😀cde",), ("ab",)], "s string")
    rows = [r[0] for r in df.select(gram_array(df.s)).collect()]
    assert rows == [["ab😀", "b😀c", "😀cd", "cde", "ab😀c", "b😀cd", "😀cde", "ab😀cd", "b😀cde"], []]


def test_tfidf_matches_brute_force(spark):
    data = texts()
    df = spark.createDataFrame(list(data.items()), "id long, s string")
    counts = {i: brute_counts(t) for i, t in data.items()}
    freq = Counter(g for c in counts.values() for g in c)
    n = len(data)
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in freq.items() if 2 <= d <= 0.95 * n}
    want = {}
    for i, c in counts.items():
        w = {g: (1 + math.log(k)) * idf[g] for g, k in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, g): x / norm for g, x in w.items()})
    got = {(r["id"], r["gram"]): r["tfidf"] for r in fit_tfidf(df, "id", "s").transform(df, "id", "s").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_cap_is_exact_also_when_slices_are_counted(spark):
    df = spark.createDataFrame(list(texts(60).items()), "id long, s string")
    vocabulary = document_frequencies(char_terms(df, "id", "s"))
    import hashlib
    rows = [(r["gram"], r["total"]) for r in vocabulary.collect()]
    ranked = sorted(rows, key=lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest()))
    for limit in (1, 17, 300):
        for rank_rows in (2, 1_000_000):
            got = {r["gram"] for r in most_frequent(vocabulary, limit, rank_rows).collect()}
            assert got == {g for g, _ in ranked[:limit]}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_texts():
    """Repeated and null ids, null and empty texts, NUL, many different characters, and one text longer than a batch."""
    rng = random.Random(5)
    many = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(6000))
    return [(1, "abcabc"), (1, "bcd"), (None, "abcd"), (None, "xabc"), (2, None), (3, ""), (4, "ab\0\0abc\0"), (5, many), (6, "abcd" * 900), (7, "ab")]


def test_counts_of_odd_texts_in_batches_of_any_size(spark):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "id long, s string")
    want = Counter()
    for i, t in rows:
        for g, n in brute_counts(t or "").items():
            want[i, g] += n
    docs = Counter(g for _, g in want)
    totals = Counter()
    for (_, g), n in want.items():
        totals[g] += n
    for chunk in (50, 3000, 1 << 20):
        got = [(r["id"], r["gram"], r["tf"]) for r in char_terms(df, "id", "s", chunk=chunk).collect()]
        assert len(got) == len(want) and {(i, g): n for i, g, n in got} == want, chunk
        frequencies = gram_frequencies(df, "id", "s", chunk=chunk).collect()
        assert {r["gram"]: (r["df"], r["total"]) for r in frequencies} == {g: (docs[g], totals[g]) for g in docs}, chunk


def test_fitting_makes_a_row_per_gram_and_batch(spark):
    df = spark.createDataFrame([(i, "abcabc") for i in range(500)], "id long, s string")
    assert "Generate" not in plan(gram_frequencies(df, "id", "s"))  # no row per occurrence or per text
    assert gram_entries(df, "id", "s", tasks=1).count() == 3 + 3 + 2
    assert {len(r["entries"]) for r in gram_entries(df, "id", "s", tasks=1).collect()} == {500}


def test_weights_are_scaled_without_a_shuffle_of_terms(spark):
    rows = [(1, "aabc"), (1, "abcx"), (None, "aabc"), (None, "xabc"), (3, "zabcx"), (4, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    found = fit_tfidf(df, "id", "s", max_df=1.0).transform(df, "id", "s")
    assert "Window" not in plan(found)
    squares = Counter()
    for r in found.collect():
        squares[r["id"]] += r["tfidf"] ** 2
    assert squares.keys() == {1, None, 3} and all(abs(s - 1) < 1e-12 for s in squares.values())
