"""Spelling variants: words one edit apart, and the frequent form that a rare one is a variant of.

Candidates come from Gram matrices. A word is the vector of its letter counts; one inserted or deleted letter moves it by
a squared distance of 1, a replaced one by 2, so near words are of the same or adjacent length and at most 2 apart. In a block pair NumPy
computes all squared distances from the products of the count vectors, and pairs at a fitting distance are verified letter by letter.

Blocks are lengths. Where the largest block measures more than `BLOCK` words, blocks are cut by counts of letter classes too: merging
letters into classes never increases a distance, so near words lie in blocks whose class counts are at most 2 apart as well, and each block
meets itself and its adjacent blocks only, each pair of blocks once. The number of classes grows until the
largest block is small; a block that stays large (anagrams) is cut into parts, and every part meets every other part and all words of the
adjacent blocks, so no pair is lost. Only one row per word and block leaves a task: its near words' number and the best of them.

Words are counted over all texts; a run's misspelling depends on its document's id (a null id counts as empty text), so repeated rows
count again. Null and empty texts hold no word. An empty table gives no row. Ties between near words go to the first in code-point order.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, id_and_text, map_batches, prepare_python, sized_join, stage_table

#: Fixed by the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words of a block, and the classes that letters are merged into, tried in turn.
BLOCK, CLASSES = 2048, (1, 2, 3, 4, 5, 6, 8)
#: Distances of a product at a time; characters of a text that are searched at a time.
CELLS, LEAF = 1 << 22, 1 << 18

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")


def runs(text: str) -> Counter:
    """Lower-cased runs of a whole text with their numbers."""
    found: Counter = Counter()
    start = 0
    while len(text) - start > LEAF and (place := _BREAK.search(text, start + LEAF)):
        found.update(RUN.findall(text, start, place.start()))
        start = place.start()
    found.update(RUN.findall(text, start))
    out: Counter = Counter()
    for run, n in found.items():
        out[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    return out


def written(doc_id, run: str, drop: int = DROP) -> str:
    """The run as the document writes it: by a hash, one letter of some runs is missing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % drop:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1:]


def word_counts(df: DataFrame, id_col="doc_id", text_col="text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts; counted per batch before the shuffle."""

    def work(batch):
        counts: Counter = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for run, n in runs(text or "").items():
                word = written(doc_id, run)
                if len(word) >= least_length:
                    counts[word] += n
        return {"word": list(counts), "n": list(counts.values())}

    counted = map_batches(id_and_text(df, id_col, text_col), work, "word string,n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# blocks --------------------------------------------------------------------------------------


def class_counts(word, classes: int):
    """Column: how many letters of the word each class has; class of a letter: its code point modulo the number of classes."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c) % classes)

    def count(k):
        return F.size(F.filter(codes, lambda code: code == k))

    return F.array(*map(count, range(classes)))


def with_blocks(words: DataFrame, most: int | None = None) -> DataFrame:
    """words with `block` (array of class counts), the classes being as many as the measured blocks need."""
    for classes in CLASSES:
        blocked = words.withColumn("block", class_counts(F.col("word"), classes))
        largest = blocked.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if largest <= (most or BLOCK):
            break
    return blocked


def steps(classes: int) -> list[list[int]]:
    """Moves between adjacent blocks, one of each opposite pair: one letter more in a class, or one from a class to a later one."""
    unit = [[int(i == j) for j in range(classes)] for i in range(classes)]
    return unit + [[a - b for a, b in zip(unit[i], unit[j])] for i in range(classes) for j in range(i)]


#: Sides of a cell: its own words, words of the same length from other blocks or parts, words that are longer by one.
OWN, SAME, LONGER = 0, 1, 2


def cells(blocked: DataFrame, most: int | None = None) -> DataFrame:
    """(block, part, side, word, n): what each part of each block is compared with. A word is in one cell and, on the
    other side, in as many as its block has adjacent parts."""
    most = most or BLOCK
    classes = blocked.select(F.max(F.size("block"))).first()[0] or 1
    sizes = stage_table(blocked.groupBy("block").count().select("block", F.ceil(F.col("count") / most).cast("int").alias("parts")), "blocks")
    own = sized_join(blocked, sizes, "block", "inner").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    before = own.filter("part > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("part") - 1)))
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps(classes)]))
    moves = sizes.select("block", "parts", step.alias("step")).select(
        F.zip_with("block", "step", lambda a, b: a + b).alias("from_block"), F.col("block").alias("to_block"), "parts",
        F.when(F.aggregate("step", F.lit(0), lambda a, b: a + b) == 0, SAME).otherwise(LONGER).alias("side"))
    moves = moves.join(sizes.select(F.col("block").alias("from_block")), "from_block", "left_semi")  # a few dozen rows per block
    far = sized_join(blocked.withColumnRenamed("block", "from_block"), stage_table(moves, "moves"), "from_block", "inner")
    far = far.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["word", "n"]
    return own.select("block", "part", F.lit(OWN).alias("side"), *names).unionByName(
        before.select("block", "part", F.lit(SAME).alias("side"), *names)).unionByName(
        far.select(F.col("to_block").alias("block"), "part", "side", *names))


# pairs ---------------------------------------------------------------------------------------


def code_points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    place = np.searchsorted(letters, codes) + len(letters) * np.arange(len(codes))[:, None]
    return np.bincount(place.ravel(), minlength=codes.shape[0] * len(letters)).reshape(len(codes), -1).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row: do two words (b longer by one, or as long) differ by exactly one inserted or replaced code point?"""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_pairs(left: np.ndarray, right: np.ndarray, same: bool = False):
    """Arrays (i, j) of near words left[i], right[j], given as code points; each pair once if both sides are the same words."""
    letters = np.unique(np.concatenate([left.ravel(), right.ravel()]))
    x, y = letter_counts(left, letters), letter_counts(right, letters)
    squares = [(z * z).sum(axis=1, keepdims=True) for z in (x, y)]
    one = [np.ones((len(z), 1), np.float32) for z in (x, y)]
    x = np.hstack([x, squares[0], one[0]])  # the product of the extended vectors is the squared distance, exact in single precision
    y = np.hstack([-2 * y, one[1], squares[1]]).T
    distance = 2 if left.shape[1] == right.shape[1] else 1
    height = max(1, CELLS // len(right))
    for start in range(0, len(left), height):
        i, j = np.nonzero(x[start:start + height] @ y == distance)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), CELLS >> 6):
            part = slice(k, k + (CELLS >> 6))
            kept = one_edit(left[i[part]], right[j[part]])
            yield i[part][kept], j[part][kept]


BEST = "word string, n_near long, form_n long, form string"


def near_words(blocked: DataFrame) -> DataFrame:
    """Rows of `BEST` per word and block pair: the number of its near words there, and the one of largest n."""
    prepare_python(blocked.sparkSession)

    def work(table: pa.Table) -> pa.Table:
        side, n = table.column("side").to_numpy(), table.column("n").to_numpy()
        words = np.array(table.column("word").to_pylist(), object)
        at = [np.flatnonzero(side == k) for k in (OWN, SAME, LONGER)]
        codes = [code_points(words[i].tolist()) if len(i) else None for i in at]
        pairs = []
        for k in (OWN, SAME, LONGER):
            if len(at[OWN]) and len(at[k]):
                pairs += [(at[OWN][i], at[k][j]) for i, j in near_pairs(codes[OWN], codes[k], k == OWN) if len(i)]
        if not pairs:
            return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
        a, b = (np.concatenate([p[k] for p in pairs] + [p[1 - k] for p in pairs]) for k in (0, 1))
        rank = np.empty(len(words), np.int64)  # of falling n, then of the word
        rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        order = np.lexsort((rank[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        return pa.table({"word": pa.array(words[a[first]], pa.string()), "n_near": pa.array(np.diff(np.append(first, len(a)))),
                         "form_n": pa.array(n[b[first]]), "form": pa.array(words[b[first]], pa.string())})

    return cells(blocked).groupBy("block", "part").applyInArrow(work, BEST)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of staged (word, form): the last form reached. Steps double, and n grows fivefold per form, so rounds are few."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage_table(sized_join(now, far, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(df: DataFrame, id_col="doc_id", text_col="text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of df."""
    words = stage_table(word_counts(df, id_col, text_col, least_length, least_count), "words")
    blocked = stage_table(with_blocks(words), "blocked")
    near = near_words(blocked).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus_n"), "form")).alias("best"))
    best = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus_n")).alias("form_n"))
    kept = F.col("form_n") >= ratio * F.col("n")
    found = stage_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")), "forms")
    known = roots(stage_table(found.filter(F.col("form").isNotNull()).select("word", "form"), "followed"))
    return sized_join(found, known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11."""
    return variants(documents(spark, sf_dir))
