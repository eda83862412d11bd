"""Public tokenizers for tasks: files are read on the driver, broadcast, and built once per worker process."""

import hashlib
import json

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

from .common import claim

_BUILT: dict = {}


class Shipped:
    """What `build(raw bytes, *options)` makes of a file, for tasks."""

    def __init__(self, spark: SparkSession, path: str, build, *options):
        with open(path, "rb") as file:
            raw = file.read()
        self.key = (build.__name__, hashlib.sha256(raw).hexdigest(), options)
        self.raw, self.build, self.options = spark.sparkContext.broadcast(raw), build, options

    def get(self):
        if self.key not in _BUILT:
            claim("vocabularies", _BUILT.clear)
            _BUILT[self.key] = self.build(self.raw.value, *self.options)
        return _BUILT[self.key]


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the usual byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The byte-level BPE of a `tokenizers` file.

    Its vocabulary is given to the faster tiktoken library as ranks, which is the same encoder if merges are listed in the order
    of the ids that they make; another file is refused. Strings of special tokens become those tokens unless `plain`.
    """

    def __init__(self, raw: bytes, pattern: str, plain: bool):
        file = json.loads(raw)
        letters = byte_letters()
        entries = {i: bytes(letters[c] for c in entry) for entry, i in file["model"]["vocab"].items()}
        ranks = {entry: i for i, entry in entries.items()}
        merges = [x if isinstance(x, list) else x.split(" ") for x in file["model"]["merges"]]
        made = [file["model"]["vocab"][a + b] for a, b in merges]
        byte = file["pre_tokenizer"]
        if file["normalizer"] or byte["type"] != "ByteLevel" or byte["add_prefix_space"] or made != sorted(made) or len(entries) != 256 + len(made):
            raise ValueError("not a plain byte-level BPE whose merges are in the order of their ids")
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={} if plain else special)
        self.allowed = set() if plain else "all"
        self.bytes_of = entries
        self.lengths = np.zeros(max([*entries, *special.values()]) + 1, np.int64)
        self.lengths[list(entries)] = [len(entry) for entry in entries.values()]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())


class PieceBpe:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = self.model.get_piece_size()
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]
        self.lengths = np.array([len(b) for b in self.bytes_of])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
