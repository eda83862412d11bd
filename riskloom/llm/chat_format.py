"""Chat formatting at token level.

Each turn is a row of segments: reserved ids around its text, which is encoded by itself, so that no merge reaches across a
control token and no text can produce one. Control strings that occur in a text are escaped, reversibly. The loss mask of
a turn is a prefix sum over the segments' boundary marks; a second prefix sum over the turns gives each turn's
token offset in its conversation. A conversation stays a run of rows and is read as a stream, however many turns it has.

Turns are ordered by (turn, role, text), nulls first, so that repeated turns have a defined order; null text and null role
count as empty; turns without a conversation id form one conversation of their own.

Template: user `[INST]` text `[/INST]`, assistant `<s>` text `</s>`, any other role `<|role|>` role `<|text|>` text `<|end|>`.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import Codec, default_codec
from .common import prepare_python

#: Control strings; their ids follow the vocabulary's 50,256 ranks and the free id 50256.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>"]
FIRST_ID = 50257
ID = {c: FIRST_ID + i for i, c in enumerate(CONTROL)}
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\|:)")


def escape(text: str) -> str:
    r"""Text without control strings: backslashes are doubled, `\:` breaks each control string after its first character."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\:" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def segments(role: str, text: str) -> list:
    """(control string, None) and (None, text, in the loss) in the template's order."""
    if role == "user":
        return [("[INST]",), (None, text, 0), ("[/INST]",)]
    if role == "assistant":
        return [("<s>",), (None, text, 1), ("</s>",)]
    return [("<|role|>",), (None, role, 0), ("<|text|>",), (None, text, 0), ("<|end|>",)]


def assemble(role: str, text: str, bpe) -> tuple[bytes, bytes, str]:
    """(packed ids, loss mask with a byte per token, formatted text) of one turn."""
    parts, lengths, loss, plain = [], [], [], []
    for first, *rest in segments(role, text):
        if first:
            ids = np.array([ID[first]], "<u4").tobytes()
            plain.append(first)
        else:
            safe = escape(rest[0])
            ids = bpe.encode(safe)
            plain.append(safe)
        parts.append(ids)
        lengths.append(len(ids) // 4)
        loss.append(rest[1] if rest else 0)
    ends = np.cumsum(lengths)
    marks = np.zeros(ends[-1] + 1, np.int8)  # +1 where a loss segment begins, -1 where it ends
    np.add.at(marks, ends - lengths, loss)
    np.subtract.at(marks, ends, loss)
    return b"".join(parts), np.cumsum(marks[:-1]).astype(np.uint8).tobytes(), "".join(plain)


SCHEMA = "conv_id long, turn long, ids binary, loss_mask binary, formatted string, position long, token_offset long"


def format_turns(turns: DataFrame, codec: Codec) -> DataFrame:
    """One row per turn, in order within each conversation: ids, loss_mask, formatted text, its position and token offset.

    `turns` has conv_id, turn, role, text. Turns are encoded where they are read, however long their conversation; then each
    conversation's rows are next to each other, sorted, in one partition.
    """
    prepare_python(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches):
        for batch in batches:
            made = [assemble(r, t, codec.get()) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            for i, (name, kind) in enumerate((("ids", pa.binary()), ("loss_mask", pa.binary()), ("formatted", pa.string()))):
                batch = batch.append_column(pa.field(name, kind), pa.array([m[i] for m in made], kind))
            yield batch

    coded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids binary, loss_mask binary, formatted string")
    coded = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        now, position, offset = object(), 0, 0
        for batch in batches:
            places, offsets = [], []
            for c, n in zip(batch.column(0).to_pylist(), pa.compute.binary_length(batch.column(3)).to_pylist()):
                if c != now:
                    now, position, offset = c, 0, 0
                places.append(position)
                offsets.append(offset)
                position += 1
                offset += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(offsets, pa.int64())],
                                             names=[x.split()[0] for x in SCHEMA.split(", ")])

    return coded.select("conv_id", "turn", "ids", "loss_mask", "formatted").mapInArrow(run, SCHEMA)


def read_turn(ids: bytes, mask: bytes, bpe) -> tuple[str, str, str | None]:
    """(role, text, text under the loss mask or None) from a turn's ids: the inverse of `assemble`."""
    codes, under = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8).astype(bool)
    cuts = np.flatnonzero(codes >= FIRST_ID)
    plain = [unescape(bpe.decode(codes[a + 1:b].tobytes()).decode()) for a, b in zip(cuts, cuts[1:])]
    first = CONTROL[codes[cuts[0]] - FIRST_ID]
    role = {"[INST]": "user", "<s>": "assistant"}.get(first, plain[0])
    loss = unescape(bpe.decode(codes[under].tobytes()).decode()) if first == "<s>" or under.any() else None
    return role, plain[-1], loss


def read_back(formatted: DataFrame, codec: Codec) -> DataFrame:
    """Per conversation what its formatted turns say, digested as a stream: no conversation is ever held in memory."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches):
        bpe, now, state = codec.get(), object(), None

        def row(c, s):
            return (c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5])

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                              names=[x.split()[0] for x in names.split(", ")])

        for batch in batches:
            done = []
            for c, ids, mask, plain in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != now or state is None:
                    if state:
                        done.append(row(now, state))
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text, loss = read_turn(ids, mask, bpe)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(plain)
                state[5] += len(mask)
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([row(now, state)])

    return formatted.select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(run, names)


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7."""
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    codec = default_codec(spark)
    return read_back(format_turns(turns.unionByName(more), codec), codec)
