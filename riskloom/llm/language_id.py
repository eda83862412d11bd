"""Language identification of mixed-language text.

A word is scored per language by its character trigrams. The script of its letters (Unicode ranges) narrows the candidate
languages first: a language that the learned rows hardly ever write in that script is no candidate, unless none is left. A Viterbi
pass over the words, with a penalty per switch, labels spans; the language with most letters is predicted, with its
share of the letters as score.

Most texts need no full pass, exactly: let A be the language with the best total, and m a word's largest advantage of any
other language over A. Every other path that contains a switch deviates from A in stretches and pays at least one penalty, so if
no stretch of m sums to the penalty, staying in A is the best path.

The model is fitted on a bounded sample: about `SAMPLE` labelled rows per language, chosen by a hash of the id. Its size
is languages x buckets. Prediction reads the text alone. Null text and text without a letter give `und`, score 0, as does every
text if no learned row has a language.
"""

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import claim, documents, id_and_text, map_batches

#: Labelled rows per language to learn from (an expectation: a hash decides), hash buckets of trigrams, cost of a switch.
SAMPLE, BUCKETS, PENALTY = 1500, 1 << 15, 12.0
#: A script is a language's own from this share of its learned letters on.
SCRIPT_SHARE = 0.005
SMOOTHING = 0.1
#: Letter ranges of common scripts (Unicode blocks): fixed values. Other letters share script 15.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]), ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)]),
    ("armenian", [(0x531, 0x58F)]), ("hebrew", [(0x590, 0x5FF)]), ("arabic", [(0x600, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF)]),
    ("devanagari", [(0x900, 0x97F)]), ("bengali", [(0x980, 0x9FF)]), ("tamil", [(0xB80, 0xBFF)]), ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF)]), ("hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]), ("kana", [(0x3040, 0x30FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)]),
]
#: Words and characters that a worker's memo may hold.
MEMO_WORDS, MEMO_CHARS = 150_000, 3_000_000
#: Letters of new words that are scored at a time.
SLICE = 100_000

_table = None


def script_table() -> np.ndarray:
    """Script number per code point, 0 for what is no letter; made once per worker."""
    global _table
    if _table is None:
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        made = np.where(letters, 15, 0).astype(np.uint8)
        for number, (_, ranges) in enumerate(SCRIPTS, 1):
            for a, b in ranges:
                made[a:b + 1] = np.where(letters[a:b + 1], number, 0)
        _table = made
    return _table


def features(words: list[str]):
    """(bucket per letter, word per letter, letters per word, script per word)."""
    words = [w.lower() for w in words]
    text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), "<u4")
    scripts = script_table()[text]
    word = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])  # by length: a word may hold U+0000 itself
    c = np.where(scripts > 0, text, 0).astype(np.uint64)  # what is no letter is a word boundary
    at = np.flatnonzero(scripts > 0)
    code = (c[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[at + 1] * np.uint64(0x165667B19E3779F9))
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    owner = word[at - 1]
    counts = np.bincount(owner, minlength=len(words))
    script = np.zeros(len(words), np.uint8)
    script[owner[::-1]] = scripts[at][::-1]  # that of the first letter
    return (code >> np.uint64(49)).astype(np.int64) % BUCKETS, owner, counts, script


class Model:
    """Languages (sorted), log probabilities (bucket x language), scripts (script x language: is a candidate)."""

    def __init__(self, counts: dict):
        self.languages = sorted({lang for lang, _, _ in counts})
        place = {x: i for i, x in enumerate(self.languages)}
        grams, scripts = np.zeros((BUCKETS, len(place))), np.zeros((16, len(place)))
        for (lang, kind, key), n in counts.items():
            (scripts if kind else grams)[key, place[lang]] += n
        total = grams.sum(axis=0)
        self.logs = np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
        own = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.candidates = np.where(own.any(axis=1, keepdims=True), own, True)
        self.reset()

    def __getstate__(self):
        return self.languages, self.logs, self.candidates

    def __setstate__(self, state):
        self.languages, self.logs, self.candidates = state
        self.reset()

    def reset(self):
        self.words, self.rows, self.letters, self.chars = _Numbers(), [], [], 0

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores per word and language, and letters per word."""
        bucket, owner, letters, script = features(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            out[:, i] = np.bincount(owner, self.logs[bucket, i], len(words))
        # a word in a script that a language does not use costs as much there as a bucket never seen, letter by letter
        out += np.where(self.candidates[script], 0, letters[:, None] * self.logs.min()).astype(np.float32)
        out[letters == 0] = 0
        return out, letters

    def slices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`word_scores` of any number of words, some thousand letters at a time: a letter takes some 50 bytes meanwhile."""
        cuts = np.cumsum([len(w) for w in words]) // SLICE
        starts = np.flatnonzero(np.append(True, cuts[1:] != cuts[:-1])).tolist()
        found = [self.word_scores(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def label(self, texts: list[str]):
        """Per text (language, score, spans of (language, first word, end))."""
        if not self.languages:
            return [("und", 0.0, []) for _ in texts]
        claim("language_id", self.reset)
        numbers = self.words
        if len(numbers) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.reset()
            numbers = self.words
        known = len(numbers)
        found = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in map(str.split, texts)]
        if len(numbers) > known:
            new = list(numbers)[known:]
            self.chars += sum(map(len, new))
            scores, letters = self.slices(new)
            self.rows = np.concatenate([self.rows, scores]) if known else scores
            self.letters = np.concatenate([self.letters, letters]) if known else letters
        return [self.path(self.rows[i], self.letters[i]) if len(i) else ("und", 0.0, []) for i in found]

    def path(self, scores: np.ndarray, letters: np.ndarray):
        total = int(letters.sum())
        if not total:
            return "und", 0.0, []
        scores = scores.astype(np.float64)
        if len(self.languages) == 1:
            return self.languages[0], 1.0, [(self.languages[0], 0, len(scores))]
        best = int(scores.sum(axis=0).argmax())
        others = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
        sums = np.concatenate([[0.0], np.cumsum(others)])
        if (sums - np.minimum.accumulate(sums)).max() < PENALTY:
            return self.languages[best], 1.0, [(self.languages[best], 0, len(scores))]
        states = viterbi(scores, PENALTY)
        by = np.bincount(states, letters, len(self.languages))
        first = int(by.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(states)) + 1).tolist(), len(states)]
        return self.languages[first], float(by[first] / total), [(self.languages[states[a]], a, b) for a, b in zip(cuts, cuts[1:])]


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best state per row; a switch costs `penalty`; ties stay, and else take the lower state."""
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    now, own = scores[0], np.arange(k)
    for i in range(1, n):
        top = int(now.argmax())
        stay = now >= now[top] - penalty
        back[i] = np.where(stay, own, top)
        now = np.where(stay, now, now[top] - penalty) + scores[i]
    states = np.empty(n, np.int64)
    states[-1] = now.argmax()
    for i in range(n - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from rows (doc_id, text, lang); rows without text or language are left out."""
    rows = rows.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().select("lang", (F.lit(float(sample)) / F.col("count")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(sizes), "lang").filter(chance < F.col("share")).select("lang", "text")  # a row per language

    def work(batch):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.split()
            if words:
                bucket, _, letters, script = features(words)
                for key, n in zip(*map(np.ndarray.tolist, np.unique(bucket, return_counts=True))):
                    counts[lang, 0, key] += n
                for key, n in enumerate(np.bincount(script, letters, 16).tolist()):
                    counts[lang, 1, key] += int(n)
        kept = [(*k, n) for k, n in counts.items() if n]
        return {"lang": [x[0] for x in kept], "kind": [x[1] for x in kept], "key": [x[2] for x in kept], "n": [x[3] for x in kept]}

    counted = map_batches(some, work, "lang string,kind int,key int,n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return Model({(r.lang, r.kind, r.key): r.n for r in counted.collect()})  # languages x (buckets + 16) rows at most


SCHEMA = "doc_id long,lang_pred string,score double,span_langs array<string>,span_starts array<long>,span_ends array<long>"


def label_languages(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, lang_pred, score, spans in words) for every row. One map over the input."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        found = shared.value.label([x or "" for x in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
                **{f"span_{name}": [[s[i] for s in x[2]] for x in found] for i, name in enumerate(("langs", "starts", "ends"))}}

    return map_batches(id_and_text(df, id_col, text_col), work, SCHEMA)


def with_language(df: DataFrame, model: Model, accept, text_col="text") -> DataFrame:
    """Rows of df whose whole text `accept(language, score)` takes, with df's own columns. One map over the input."""
    import pyarrow as pa

    from .common import prepare_python

    prepare_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([accept(*x[:2]) for x in shared.value.label([x or "" for x in texts])], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def learned_rows(df: DataFrame) -> DataFrame:
    return df.filter(~held_out(F.col("doc_id")))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9."""
    rows = documents(spark, sf_dir)
    model = fit(learned_rows(rows))
    return label_languages(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                                               F.size("span_langs").alias("n_spans"))
