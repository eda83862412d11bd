"""Alignment of two tokenizers by an inverted index of token pairs.

Both tokenize the same bytes. Where tokens of both end, a group ends; a link is a pair of tokens (A, B) whose byte ranges overlap. How
many documents hold an id pair is counted with inverted pair bitmaps:

1. Documents are numbered (chunk, place), a chunk being up to `CHUNK` rows of an input partition. Per pair and chunk a posting holds
   bitmaps over the places, one per bit of the pair's number of links in a document (multiplicity planes). A
   bitmap is compressed: sorted 16-bit places while those are shorter than the bits themselves.
2. The OR of a posting's planes is the pair's document bitmap, its popcount the number of documents; the popcounts of the planes,
   times powers of two, are the links. Both add up over postings, which hold different documents (a task writes a chunk in several
   postings when its links outgrow `LINKS`).
3. Pair counts and the largest count of each A id go back to the postings, and those return each document's scores.

Links are never written one by one. The pair counts are measured, and broadcast only when small; otherwise postings are shuffled by pair and then by
chunk. A pair in a third of all documents is one posting per chunk. Repeated rows are documents of their own, as are rows without an
id. Texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros and ''.
An empty table gives no row. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_schema, documents, id_and_text, prepare_python, sized_join, stage_table
from .vocabularies import ByteBpe, PieceBpe, Shipped

#: Documents of a chunk (16-bit places), and links that a task gathers before it writes postings.
CHUNK, LINKS = 8192, 4_000_000
#: Characters from which on a text is cut between two letters with one blank between them.
LEAF = 1 << 16

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
INDEX = "chunk long,place int,doc_id long," + ",".join(f"{c} long" for c in COUNTS) + ",groups_sha256 string,pair long,planes array<binary>"
SCORES = "chunk long,place int,n_best long,count_sum long"
_INDEX_SCHEMA = pa.schema([f if f.name != "planes" else pa.field("planes", pa.list_(pa.binary()))
                           for f in [*arrow_schema(INDEX.rsplit(",", 1)[0]), pa.field("planes", pa.binary())]])


class Labels:
    """Ids as text with the separators that may follow them: object arrays, to be picked from and joined."""

    def __init__(self, n: int, end: str):
        self.inner = np.array([f"{i}," for i in range(n)], object)
        self.last = np.array([f"{i}{end}" for i in range(n)], object)

    def of(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.where(last, self.last[ids], self.inner[ids])


def cut(text: str) -> list[str]:
    """Parts of a text, each but the first beginning with a blank between two letters: no token of either kind spans such a place."""
    parts, start = [], 0
    while len(text) - start > LEAF:
        place = text.find(" ", start + LEAF)
        while place >= 0 and not (text[place - 1].isascii() and text[place - 1].isalpha() and text[place + 1:place + 2].isascii() and text[place + 1:place + 2].isalpha()):
            place = text.find(" ", place + 1)
        if place < 0:
            break
        parts.append(text[start:place])
        start = place
    return [*parts, text[start:]]


class Aligner:
    """Tokens, groups and links of texts under two vocabularies."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.labels = Labels(len(a.lengths), "|"), Labels(len(b.lengths), ";")
        self.width = len(b.lengths)

    def tokens(self, text: str):
        """(A ids, B ids) of blank + text; None if there are none."""
        if not text:
            return None
        parts = cut(text)
        in_b = [i for ids in self.b.encode([parts[0], *(p[1:] for p in parts[1:])]) for i in ids]  # B adds the blank itself
        if b"".join(map(self.b.bytes_of.__getitem__, in_b)) != b" " + text.encode():
            return None
        in_a = np.concatenate([self.a.encode(p) for p in [" " + parts[0], *parts[1:]]])
        return in_a.astype(np.int64), np.array(in_b, np.int64)

    def align(self, text: str):
        """(n_a, n_b, n_groups, groups digest, pair of every link)."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, "", np.empty(0, np.int64)
        in_a, in_b = found
        end_a, end_b = np.cumsum(self.a.lengths[in_a]), np.cumsum(self.b.lengths[in_b])
        if end_a[-1] != end_b[-1]:
            return 0, 0, 0, "", np.empty(0, np.int64)
        # Every stretch between two neighbouring ends lies in one A token and one B token, and each link is one stretch.
        ends = np.concatenate([end_a, end_b])
        ends.sort()
        ends = ends[np.append(ends[1:] != ends[:-1], True)]
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last_a, last_b = np.zeros(len(in_a), bool), np.zeros(len(in_b), bool)
        both = (end_a[of_a] == ends) & (end_b[of_b] == ends)
        last_a[of_a[both]] = last_b[of_b[both]] = True
        n_groups = int(both.sum())
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        parts = np.empty(len(in_a) + len(in_b), object)
        parts[np.arange(len(in_a)) + np.searchsorted(group_b, group_a)] = self.labels[0].of(in_a, last_a)
        parts[np.arange(len(in_b)) + np.searchsorted(group_a, group_b, "right")] = self.labels[1].of(in_b, last_b)
        digest = hashlib.sha256("".join(parts.tolist())[:-1].encode()).hexdigest()
        return len(in_a), len(in_b), n_groups, digest, in_a[of_a] * self.width + in_b[of_b]


# bitmaps -------------------------------------------------------------------------------------


def pack_bitmaps(owner: np.ndarray, place: np.ndarray, n: int) -> pa.Array:
    """Compressed bitmaps of `n` owners from rows (owner, place) in order: 16-bit places, or all `CHUNK` bits if those are shorter."""
    count = np.bincount(owner, minlength=n)
    size = np.minimum(count, CHUNK // 16)  # in units of two bytes
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint16)
    first = np.cumsum(count) - count
    sparse = (count < CHUNK // 16)[owner]
    rank = np.arange(len(owner)) - first[owner]
    out[(start[owner] + rank)[sparse]] = place[sparse]
    for i in np.flatnonzero(count >= CHUNK // 16):
        bits = np.zeros(CHUNK, np.uint8)
        bits[place[first[i]:first[i] + count[i]]] = 1
        out[start[i]:start[i + 1]] = np.packbits(bits, bitorder="little").view(np.uint16)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * start).astype(np.int32)), pa.py_buffer(out)])


def unpack_bitmaps(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows (owner, place) of compressed bitmaps."""
    if not len(bitmaps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32, len(bitmaps) + 1, 4 * bitmaps.offset).astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint16) if offsets[-1] > offsets[0] else np.empty(0, np.uint16)
    start = (offsets - offsets[0]) // 2
    size = np.diff(start)
    owner = np.repeat(np.arange(len(size)), size)
    sparse = (size < CHUNK // 16)[owner]
    owners, places = [owner[sparse]], [data[sparse].astype(np.int64)]
    for i in np.flatnonzero(size >= CHUNK // 16):
        found = np.flatnonzero(np.unpackbits(data[start[i]:start[i + 1]].view(np.uint8), bitorder="little"))
        owners.append(np.full(len(found), i))
        places.append(found)
    return np.concatenate(owners), np.concatenate(places)


def postings(links: list[np.ndarray], places: list[int]) -> tuple[np.ndarray, pa.Array]:
    """(pairs, planes of each) of the links of documents at the given places."""
    key = np.concatenate(links) << 16
    key |= np.repeat(np.array(places, np.int64), [len(x) for x in links])
    key.sort()
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(cuts, len(key)))
    key = key[cuts]
    pair, place = key >> 16, key & 0xFFFF
    new = np.append(True, pair[1:] != pair[:-1])
    pairs, owner = pair[new], np.cumsum(new) - 1
    most = np.maximum.reduceat(times, np.flatnonzero(new))
    planes = np.frexp(most)[1].astype(np.int64)  # bits of the largest multiplicity
    start = np.concatenate([[0], np.cumsum(planes)])
    rows, at = [], []
    for bit in range(int(planes.max())):
        has = (times >> bit & 1).astype(bool)
        rows.append(start[owner[has]] + bit)
        at.append(place[has])
    rows, at = np.concatenate(rows), np.concatenate(at)
    order = np.argsort(rows, kind="stable")
    return pairs, pa.ListArray.from_arrays(pa.array(start, pa.int32()), pack_bitmaps(rows[order], at[order], int(start[-1])))


def planes_of(planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (posting, place, multiplicity of one plane) of an array of postings' planes."""
    offsets = planes.offsets.to_numpy()
    flat = planes.values.slice(offsets[0], offsets[-1] - offsets[0])
    start = offsets - offsets[0]
    owner, place = unpack_bitmaps(flat)
    posting = np.repeat(np.arange(len(planes)), np.diff(start))[owner]
    return posting, place, np.int64(1) << (owner - start[posting])


def document_counts(planes: pa.Array) -> np.ndarray:
    """Popcount of each posting's document bitmap, the OR of its planes."""
    posting, place, _ = planes_of(planes)
    key = posting * CHUNK + place
    several = np.diff(planes.offsets.to_numpy())[posting] > 1
    key = np.concatenate([key[~several], np.unique(key[several])])  # OR: a place that several planes hold counts once
    return np.bincount(key // CHUNK, minlength=len(planes))


# tables --------------------------------------------------------------------------------------


def index(df: DataFrame, a: Shipped, b: Shipped, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of `INDEX`: one per document (pair is null), and the postings (doc_id and counts are null)."""
    prepare_python(df.sparkSession)
    schema = _INDEX_SCHEMA

    def rows(n, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else
                                           pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        aligner = Aligner(a.get(), b.get())
        chunk, place, links, places, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            pairs, planes = postings(links, places)
            for i in range(0, len(pairs), 1 << 15):
                part = pairs[i:i + (1 << 15)]
                yield rows(len(part), chunk=np.full(len(part), chunk), pair=part, planes=planes.slice(i, len(part)))

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if place == CHUNK or held > LINKS:
                    if held:
                        yield from flush()
                    links, places, held = [], [], 0
                    if place == CHUNK:
                        chunk, place = chunk + 1, 0
                n_a, n_b, n_groups, digest, pairs = aligner.align(text or "")
                out.append((chunk, place, doc_id, n_a, n_b, n_groups, len(pairs), digest))
                if len(pairs):
                    links.append(pairs)
                    places.append(place)
                    held += len(pairs)
                place += 1
            if out:
                yield rows(len(out), **dict(zip(schema.names, (list(x) for x in zip(*out)))))
        if held:
            yield from flush()

    return id_and_text(df, id_col, text_col).mapInArrow(run, INDEX)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs) of postings (pair, planes): documents that hold the pair."""
    schema = arrow_schema("pair long,docs long")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(document_counts(batch.column(1)), pa.int64())], schema=schema)

    return found.select("pair", "planes").mapInArrow(run, "pair long,docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def returned_scores(found: DataFrame) -> DataFrame:
    """Rows of `SCORES`, to be summed by document, of postings (chunk, planes, docs, best)."""
    schema = arrow_schema(SCORES)

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def flush():
            for chunk, sums in held.items():
                place = np.flatnonzero(sums[0])
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), chunk)), pa.array(place, pa.int32()),
                                                      pa.array(sums[1][place]), pa.array(sums[0][place])], schema=schema)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, docs, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            posting, place, times = planes_of(batch.column(1))
            names, local = np.unique(chunks, return_inverse=True)
            at = local[posting] * CHUNK + place
            for k, weight in enumerate((docs[posting], best[posting])):
                sums = np.zeros(len(names) * CHUNK, np.int64)
                np.add.at(sums, at, times * weight)
                for i, name in enumerate(names.tolist()):
                    held.setdefault(name, np.zeros((2, CHUNK), np.int64))[k] += sums[i * CHUNK:(i + 1) * CHUNK]
            if len(held) > 64:
                yield from flush()
        yield from flush()

    return found.select("chunk", "planes", "docs", F.col("best").cast("long").alias("best")).mapInArrow(run, SCORES)


def align_tokenizers(df: DataFrame, a: Shipped, b: Shipped, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of df."""
    from .common import BROADCAST_BYTES, table_bytes

    made = stage_table(index(df, a, b, id_col, text_col), "pair_index")
    found = made.filter(F.col("pair").isNotNull()).select("chunk", "pair", "planes")
    counted = stage_table(pair_counts(found), "pair_counts")
    of_a = (F.col("pair") / F.lit(len(b.get().lengths))).cast("long")  # ids are far below 2^53: the quotient is exact enough to cut
    highest = counted.groupBy(of_a.alias("a")).agg(F.max("docs").alias("most"))
    marked = stage_table(counted.withColumn("a", of_a).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair_scores")
    if table_bytes(marked) <= BROADCAST_BYTES:
        scored = found.join(F.broadcast(marked), "pair")
    else:
        scored = found.join(marked, "pair").repartition("chunk")
    scores = returned_scores(scored).groupBy("chunk", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = made.filter(F.col("pair").isNull()).drop("pair", "planes")
    return rows.join(scores, ["chunk", "place"], "left").select(
        "doc_id", *COUNTS, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def default_codecs(spark: SparkSession) -> tuple[Shipped, Shipped]:
    import public_tokenizers

    return (Shipped(spark, public_tokenizers.path("byte_bpe_50k.json"), ByteBpe, public_tokenizers.PATTERN, True),
            Shipped(spark, public_tokenizers.path("piece_bpe_32k.model"), PieceBpe))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13."""
    return align_tokenizers(documents(spark, sf_dir), *default_codecs(spark))
