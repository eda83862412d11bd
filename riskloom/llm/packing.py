"""Best-fit packing of documents into sequences of a fixed length.

A document is its ids and a separator. Longer ones are cut from the end into pieces of the full length, so only their first piece
may be shorter. Pieces are dealt to tasks, and each task packs its own by best-fit decreasing: the longest piece first, into the open sequence
with the least remaining room that holds it. A segment tree over the remaining capacities (leaf r: sequences with
room r) finds that sequence in steps logarithmic in the sequence length, however many sequences are open.

The number of tasks follows the measured tokens and pieces, so a task holds some thousand sequences and the loss by dealing is
small; sequences that stay at most half full are then packed again, as items of their filled length, until one task holds
all of them. Dealing is by a row number, not by id, so repeated ids, null ids and very long documents spread evenly. Numbers
are written to a table first: reruns of a task deal and pack the same rows in the same order.

Null text counts as empty: just the separator. Repeated rows are packed each. An empty table gives no row. Ids are those of the
`tokenizers` library; a special token's string in a text is that token, as there.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_schema, documents, id_and_text, prepare_python, sized_join, stage_table
from .vocabularies import ByteBpe, Shipped

LENGTH, SEPARATOR = 2048, 0
#: Most tokens and pieces (averages) of a packing task.
TASK_TOKENS, TASK_PIECES = 1 << 24, 1 << 18

PIECES = "row long,doc_id long,piece int,start long,length long,ids_crc32 long"
PLACES = "row long,sequence_id long,offset long"


class Room:
    """Open sequences by remaining room: a segment tree whose nodes say whether a sequence is open below."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.open = [0] * (2 * self.leaves)  # open sequences below a node
        self.at = [[] for _ in range(self.leaves)]

    def add(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        i = room + self.leaves
        while i:
            self.open[i] += 1
            i >>= 1

    def take(self, least: int):
        """(room, sequence) of the tightest open sequence with room for `least`, removed; None if there is none."""
        tree, i = self.open, least + self.leaves
        while not tree[i]:
            while i & 1:  # a right child: what lies to the right begins at a subtree further up
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            tree[i] -= 1
            i >>= 1
        return room, self.at[room].pop()


def best_fit(lengths, length: int = LENGTH):
    """(sequence, offset) per item of falling lengths; sequences are numbered from 0."""
    rooms, sequence, offset, n = Room(length), [], [], 0
    for size in lengths:
        found = rooms.take(size)
        if found is None:
            found, n = (length, n), n + 1
        room, which = found
        sequence.append(which)
        offset.append(length - room)
        if room > size:
            rooms.add(room - size, which)
    return sequence, offset


def pieces(df: DataFrame, codec: Shipped, id_col="doc_id", text_col="text", length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """Rows of `PIECES` for the whole text of every row; `row` numbers them uniquely."""
    prepare_python(df.sparkSession)
    schema = arrow_schema(PIECES)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(codec.get().encode(text or ""), separator).astype("<u4")
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((row, doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    return id_and_text(df, id_col, text_col).mapInArrow(run, PIECES)


def _pack_once(items: DataFrame, tasks: int, length: int) -> DataFrame:
    """Rows of `PLACES` of items (row, length); a task packs what it is dealt."""
    schema = arrow_schema(PLACES)

    def run(batches):
        task = TaskContext.get().partitionId() << 40
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            rows, sizes = (table.column(i).to_numpy() for i in range(2))
            order = np.lexsort((rows, -sizes))
            sequence, offset = best_fit(sizes[order].tolist(), length)
            for i in range(0, len(order), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(rows[order[part]]), pa.array(np.array(sequence[part], np.int64) + task),
                                                  pa.array(np.array(offset[part], np.int64))], schema=schema)

    return items.select("row", "length").repartition(tasks, "row").mapInArrow(run, PLACES)


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of `PLACES` for the staged items (row, length) with unique rows and lengths from 1 to `length`."""
    spark = items.sparkSession
    prepare_python(spark)
    done, level = None, 0
    while True:
        measured = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        tasks = max(1, -(-measured["tokens"] // TASK_TOKENS), -(-measured["n"] // TASK_PIECES))
        now = stage_table(_pack_once(items, tasks, length).withColumn(
            "sequence_id", F.col("sequence_id") * 64 + F.lit(level)), "places")  # levels don't share numbers
        if done is None:
            done = now
        else:  # sequences of the last level were the items: theirs move to where the item went
            moved = now.select(F.col("row").alias("old"), F.col("sequence_id").alias("new"), F.col("offset").alias("shift"))
            done = sized_join(done, moved, F.col("sequence_id") == F.col("old"), "left").select(
                "row", F.coalesce("new", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
            done = stage_table(done, "places")
        if tasks == 1:
            return done
        filled = now.join(items.select("row", "length"), "row").groupBy("sequence_id").agg(F.sum("length").alias("length"))
        items = stage_table(filled.filter(F.col("length") <= length // 2).select(F.col("sequence_id").alias("row"), "length"), "open")
        level += 1


def pack_documents(df: DataFrame, codec: Shipped, id_col="doc_id", text_col="text", length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of df."""
    cut = stage_table(pieces(df, codec, id_col, text_col, length, separator), "pieces")
    return cut.join(pack(cut, length), "row").drop("row")


def default_codec(spark: SparkSession, plain: bool = False) -> Shipped:
    import public_tokenizers

    return Shipped(spark, public_tokenizers.path("byte_bpe_50k.json"), ByteBpe, public_tokenizers.PATTERN, plain)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12."""
    return pack_documents(documents(spark, sf_dir), default_codec(spark))
