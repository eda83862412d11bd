"""Byte-level BPE as a monoid tree reduction.

The encoding of a byte string is an element of a monoid whose product is `join`: halves are encoded
recursively down to single bytes, whose ids the ranks give, and neighbours are joined by re-encoding a window around the
boundary. Why this is exact: a token sequence is the encoding of its bytes if, and only if, each adjacent pair of tokens encodes to itself
(merges run in rank order, so the first merge that would cross a boundary would also cross it when just the
two tokens around it are encoded). So once the first token of the re-encoded window and the token before it encode to
themselves, and the last one and the token after it do, all pairs are stable: tokens outside provably stay. Otherwise the
window doubles, until it holds everything.

Text is cut before a blank that follows a non-blank: no match of the split pattern spans such a place, so
there the product is plain concatenation, of leaves in one walk. Decoding concatenates up a tree. A memo per worker
keeps the ids of short words; it saves time only.

Null text counts as empty and gives no ids. Ids are packed as little-endian unsigned 32-bit integers. Repeated rows and rows
without an id are encoded like others; other columns are carried along, but for one named like the result, which is replaced.
"""

import base64
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import claim, documents, prepare_python

#: What the split pattern's \s means for the vocabulary (Unicode White_Space; Python's own \s has four more).
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters from which on a leaf of a text ends at the next cut; ids of a leaf of the decoding tree.
TEXT_LEAF, ID_LEAF = 1 << 15, 1 << 16
#: A window of up to so many bytes is merged in a list, a longer one with a heap; the rank of a pair that is no entry.
SHORT, NEVER = 40, 1 << 62
MARKS = frozenset(".,;:!?")
#: Entries that each memo of a worker may hold: of words, and of parts of words and pairs of tokens; the longest keys.
MEMO, MEMO_PARTS, MEMO_KEY = 250_000, 250_000, 48


class _Memo(dict):
    """Results of `compute` for short keys, in two generations: when the young one is full, the old one goes, so words in use stay."""

    def __init__(self, compute, longest: int = MEMO_KEY, most: int = None):
        self.compute, self.longest, self.most, self.old = compute, longest, most or MEMO, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Texts:
    """Packed ids of whole texts from those of their chunks; words are kept in a memo. Encoders say what `_chunk` gives."""

    def __init__(self):
        self.cut = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
        self.chunks = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
        self.blank_then_space = re.compile(f"[{BLANK}] ")
        self.plain = _Memo(self._chunk)
        self.spaced = _Memo(lambda word: self._chunk(" " + word))

    def _chunk(self, chunk: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if len(text) > TEXT_LEAF:
            return b"".join(map(self._leaf, self.leaves(text)))
        return self._leaf(text)

    def leaves(self, text: str):
        """The text in order, cut at the first place from `TEXT_LEAF` characters on: one walk, whatever the order of long and short words."""
        start = 0
        while place := self.cut.search(text, start + TEXT_LEAF):
            yield text[start:place.start()]
            start = place.start()
        yield text[start:]

    def _leaf(self, text: str) -> bytes:
        if self.blank_then_space.search(text):
            return b"".join(map(self.plain.__getitem__, self.chunks.findall(text)))
        first, *words = text.split(" ")
        return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, words))


class _Pairs(dict):
    """Encoding of two tokens' bytes, by a << 32 | b; empty if they encode to themselves."""

    def __init__(self, bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            a, b = key >> 32, key & 0xFFFFFFFF
            ids = tuple(self.bpe.merge(self.bpe.bytes_of[a] + self.bpe.bytes_of[b]))
            ids = () if ids == (a, b) else ids
        if len(self) >= MEMO_PARTS // 2:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Bpe(Texts):
    """Encoder and decoder for a table of ranks {bytes: id} and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.part = _Memo(self.piece, 6, MEMO_PARTS)
        self.pairs = _Pairs(self)
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]"))

    # one piece -------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list:
        """Ids of a byte string: of all adjacent pairs the one of least rank merges, the leftmost first, until no pair has a rank."""
        n, ranks = len(data), self.ranks
        if n <= SHORT:
            parts = [data[i:i + 1] for i in range(n)]
            order = [ranks.get(data[i:i + 2], NEVER) for i in range(n - 1)]
            while order:
                rank = min(order)
                if rank == NEVER:
                    break
                i = order.index(rank)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
                if i < len(order):
                    order[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            return [ranks[x] for x in parts]
        ends = list(range(1, n + 1))  # of the part that begins there; 0 once it is merged into the one before
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        before = list(range(-1, n - 1))
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two has merged since
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (rank := ranks.get(data[i:ends[end]])) is not None:
                    heapq.heappush(heap, (rank, i, ends[end]))
            if i and (rank := ranks.get(data[before[i]:end])) is not None:
                heapq.heappush(heap, (rank, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:ends[i]]])
            i = ends[i]
        return out

    def piece(self, piece: bytes) -> list:
        """Ids of one match of the split pattern, or of a part of it (`part` is the same with a memo of short ones)."""
        if len(piece) < 2:
            return [self.ranks[piece]] if piece else []
        middle = len(piece) // 2
        return self.join(self.part[piece[:middle]], self.part[piece[middle:]])

    def join(self, left: list, right: list) -> list:
        """Encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left or right
        of, pairs = self.bytes_of, self.pairs
        window = pairs[left[-1] << 32 | right[0]]
        if not window:
            return left + right
        k = 1
        while True:
            if k >= len(left) or not pairs[left[-k - 1] << 32 | window[0]]:
                if k >= len(right) or not pairs[window[-1] << 32 | right[k]]:
                    return [*left[:-k], *window, *right[k:]]
            k *= 2
            window = self.merge(b"".join([of[i] for i in left[-k:]]) + b"".join([of[i] for i in right[:k]]))

    # texts -----------------------------------------------------------------------------------

    def known(self, chunk: str) -> bytes:
        """Packed ids of a chunk, by the memo it belongs to."""
        return self.spaced[chunk[1:]] if chunk[0] == " " else self.plain[chunk]

    def _chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            ids = self.part[chunk.encode()]
        elif word[-1:] in MARKS and word[:-1].isalpha():  # letters and one mark are two matches
            return self.known(chunk[:-1]) + self.plain[word[-1]]
        elif word.count("\n") == 1 and (place := word.find("\n")) > 0 and word[place + 1:place + 2].isalpha() and not word[place - 1].isspace():
            place += len(chunk) - len(word)  # a line break between a non-blank and a letter is a match (one only: no deep recursion)
            return self.known(chunk[:place]) + self.plain["\n"] + self.plain[chunk[place + 1:]]
        else:
            ids = [i for piece in self.pieces.findall(chunk) for i in self.part[piece.encode()]]
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids; an id outside the vocabulary raises KeyError."""
        if len(ids) > 4 * ID_LEAF:
            middle = len(ids) // 8 * 4
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_CODECS: dict[int, Bpe] = {}


class Codec:
    """A vocabulary for tasks: the rank file (under 1 MB here) is read on the driver and broadcast once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.raw = spark.sparkContext.broadcast(file.read())
        self.pattern = pattern

    def get(self) -> Bpe:
        """The worker's encoder, with its memos; made once per worker process."""
        raw = self.raw.value
        key = hash((raw, self.pattern))
        if key not in _CODECS:
            claim("bpe", _CODECS.clear)
            _CODECS.clear()
            _CODECS[key] = Bpe(parse_ranks(raw), self.pattern)
        return _CODECS[key]


def default_codec(spark: SparkSession) -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _with_binary(df: DataFrame, column: str, out: str, make) -> DataFrame:
    """df with a binary column made from one column batch by batch; a column named `out` is replaced."""
    prepare_python(df.sparkSession)
    schema = df.drop(out).withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches):
        for batch in batches:
            made = pa.array(make(batch.column(batch.schema.get_field_index(column))), pa.binary())
            place = batch.schema.get_field_index(out)
            if place >= 0:
                batch = batch.drop_columns([out])
            yield batch.append_column(pa.field(out, pa.binary()), made)

    return df.mapInArrow(run, schema)


def encode_texts(df: DataFrame, codec: Codec, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with the packed ids of every whole text. Map-only: no shuffle, whatever the key distribution."""
    return _with_binary(df, text_col, out, lambda column: [codec.get().encode(x or "") for x in column.to_pylist()])


def decode_ids(df: DataFrame, codec: Codec, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that packed ids stand for; null ids give null."""
    return _with_binary(df, ids_col, out, lambda column: [None if x is None else codec.get().decode(x) for x in column.to_pylist()])


def round_trip(df: DataFrame, codec: Codec, text_col: str = "text") -> DataFrame:
    """df without the text, with its packed `ids` and the bytes `decoded` from them: both in one pass, by one Python worker."""
    prepare_python(df.sparkSession)
    schema = df.drop("ids", "decoded", text_col).withColumns({c: F.lit(None).cast("binary") for c in ("ids", "decoded")}).schema

    def run(batches):
        for batch in batches:
            ids = [codec.get().encode(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            decoded = pa.array([codec.get().decode(x) for x in ids], pa.binary())
            batch = batch.drop_columns([c for c in ("ids", "decoded", text_col) if c in batch.schema.names])
            yield batch.append_column(pa.field("ids", pa.binary()), pa.array(ids, pa.binary())).append_column(pa.field("decoded", pa.binary()), decoded)

    return df.mapInArrow(run, schema)


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1."""
    coded = round_trip(documents(spark, sf_dir).select("doc_id", "text"), default_codec(spark))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
