"""Quoted CSV files whose records span lines, read by many tasks.

A line turns the state at its start (outside or inside a quoted value) into the state at its end. So it is one of four maps: always outside, always
inside, unchanged, exchanged. Maps are combined over the lines of a block, the blocks' maps over a file; then every line's true state is known,
wherever its block begins. Lines that are whole records stay where they are; only lines of longer records are grouped.

Lines end with \\n or \\r\\n. Blank lines between records are no records; a file without lines gives no rows; a quote that is never closed makes the rest of
its file one value, as in an unsplit read (a last line end is added where the file has none). Empty values are null.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .staging import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# One field of a line, and a quoted value that the line leaves open. Possessive: linear time, no deep stack.
_IN_QUOTES = '[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:[^",][^,]*+|"{_IN_QUOTES}"[^,]*+)?+,)*+'
_OPEN = f'{_FIELDS}"{_IN_QUOTES}\\z'
#: Lines after which a value is still open, if none was open before them, and if one was.
OPENED = f"\\A{_OPEN}"
STILL_OPEN = f'\\A{_IN_QUOTES}(?:\\z|"[^,]*+,{_OPEN})'

#: Column with the place of a record.
PLACE = "__place"

_BLOCK = "file string, block long"
_MAPS = _BLOCK + ", then_0 boolean, then_1 boolean, first_0 long, first_1 long, last_0 long, last_1 long"
_LINES = _BLOCK + ", line long, value string, " + ", ".join(f"open_{s} boolean, start_{s} long, whole_{s} boolean" for s in (0, 1))


def read_split_csv(spark: SparkSession, path, columns=None) -> DataFrame:
    """(`PLACE`, columns) of headered CSV files, all columns as strings; `PLACE` is (file, block, position of the first line in its block).

    `columns` are those of the header; None takes them from the first file. A file with another header raises an error in the job.
    """
    if columns is None:
        columns = spark.read.options(header=True, escape='"', multiLine=True).csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in columns])
    lines = _coded_lines(spark, path)
    # staged: one narrow row per block, of known size, so the lines are shuffled to it only if it is too large to broadcast
    records = _records(lines, stage_table(block_states(lines), "csv-blocks"))
    parsed = records.select(PLACE, "is_header", F.from_csv("record", schema.simpleString(), {"escape": '"', "multiLine": "true"}).alias("c"))
    wrong = F.lit(False)
    for name in columns:
        if not name.startswith("_c"):  # an empty name in the header
            wrong |= ~F.lower(F.coalesce(F.replace(F.col("c")[name], F.lit("\ufeff"), F.lit("")), F.lit(""))).eqNullSafe(F.lit(name.lower()))
    message = F.concat(F.lit("another header than the first file's: "), F.col(f"{PLACE}.file"))
    kept = parsed.filter(F.when(F.col("is_header") & wrong, F.raise_error(message).cast("boolean")).otherwise(~F.col("is_header")))
    return kept.select(PLACE, *[F.col("c")[name].alias(name) for name in columns])


def spans_lines(spark: SparkSession, path) -> bool:
    """Whether a line with an odd number of quotes exists; without one, no record can span lines."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def _coded_lines(spark, path) -> DataFrame:
    """(file, block, value, opened, still_open, blank) of every line, in the order of the scan."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.rlike("value", F.lit(OPENED)).alias("opened"), F.rlike("value", F.lit(STILL_OPEN)).alias("still_open"),
        F.rlike("value", F.lit("\\A\\r?\\z")).alias("blank"))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, carried, header): per block whether it begins inside a value, where the record it begins in starts, and where its file's
    first record starts. Only codes of lines are looked at; the windows hold one narrow row per block."""
    blocks = lines.select("file", "block", "opened", "still_open", "blank").mapInArrow(_block_maps, _MAPS)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the state after the last block that forgets its start, and the exchanges since then
    blocks = blocks.withColumn("swaps", F.sum(F.when(~F.col("then_1") & F.col("then_0"), 1).otherwise(0)).over(to_here))
    odd = F.col("swaps") % 2 == 1
    blocks = blocks.withColumn("base", F.when(F.col("then_0") == F.col("then_1"), F.col("then_0") != odd))
    swaps = F.coalesce(F.last("swaps").over(before), F.lit(0))
    inside = F.coalesce(F.last("base", ignorenulls=True).over(before), F.lit(False)) != (swaps % 2 == 1)
    blocks = blocks.withColumn("inside", inside)
    for part in ("first", "last"):
        at = F.when(F.col("inside"), F.col(f"{part}_1")).otherwise(F.col(f"{part}_0"))
        blocks = blocks.withColumn(part, F.when(at.isNotNull(), F.struct("block", at.alias("line"))))
    return blocks.select("file", "block", "inside", F.last("last", ignorenulls=True).over(before).alias("carried"),
                         F.first("first", ignorenulls=True).over(whole).alias("header"))


def _records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(place, is_header, record): lines that are whole records as they are, the others joined by the record that they belong to."""
    lines = lines.mapInArrow(_line_places, _LINES).join(states, ["file", "block"])

    def by_state(name):
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    start = by_state("start")
    start = F.when(start.isNotNull(), F.struct("block", start.alias("line"))).otherwise(F.col("carried"))
    lines = lines.select("file", "block", "line", "value", "header", start.alias("start"), by_state("whole").alias("whole"), by_state("open").alias("open"))
    lines = lines.filter("open OR (start.block = block AND start.line = line)")  # all but blank lines between records
    place = F.struct("file", F.col("start.block").alias("block"), F.col("start.line").alias("position")).alias(PLACE)
    header = (F.col("start") == F.col("header")).alias("is_header")
    record = F.when(F.rlike("record", F.lit(OPENED)), F.concat("record", F.lit("\n"))).otherwise(F.regexp_replace("record", "\\r\\z", ""))
    short = lines.filter("whole").select("file", "start", "header", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    long = lines.filter("NOT whole AND start IS NOT NULL").groupBy("file", "start").agg(parts.alias("parts"), F.first("header").alias("header"))
    long = long.select("file", "start", "header", F.array_join("parts.value", "\n").alias("record"))
    return short.unionByName(long).select(place, header, record.alias("record"))


def _walk(opened, still_open, inside):
    """State before each line and after the last one, by the last line that forgets its start and the exchanges since then."""
    swap, fixed = opened & ~still_open, opened == still_open
    swaps = np.cumsum(swap)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(opened)), -1))
    known = last >= 0
    at = np.maximum(last, 0)
    after = np.where(known, opened[at] ^ (((swaps - swaps[at]) % 2) == 1), inside ^ (swaps % 2 == 1))
    return np.concatenate(([inside], after[:-1])), bool(after[-1])


def _pieces(batches):
    """(columns of a run of lines of one block, whether a new block begins), in the order of the scan."""
    seen = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (codes[1:] != codes[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            key = (files.dictionary[int(codes[low])].as_py(), int(block[low]))
            yield batch.slice(low, high - low), key, key != seen
            seen = key


class _Place:
    """What is known in a block so far, for both states that it may begin in."""

    def __init__(self):
        self.state, self.first, self.last, self.lines = [False, True], [None, None], [None, None], 0

    def add(self, piece):
        """Per possible first state: open before, start of the record, whole record; of each line in the piece."""
        flags = [piece.column(name).to_numpy(zero_copy_only=False) for name in ("opened", "still_open", "blank")]
        number, found = np.arange(self.lines, self.lines + piece.num_rows), []
        for s in (0, 1):
            before, end = _walk(flags[0], flags[1], self.state[s])
            starts = ~before & ~flags[2]
            carried = -1 if self.last[s] is None else self.last[s]
            start = np.maximum.accumulate(np.where(starts, number, carried))
            if starts.any():
                self.first[s] = int(number[starts][0]) if self.first[s] is None else self.first[s]
                self.last[s] = int(start[-1])
            self.state[s] = end
            found.append((before, start, starts & ~flags[0]))
        self.lines += piece.num_rows
        return number, found


def _block_maps(batches):
    """One row per block: the state after it and its first and last start of a record, for both states before it."""
    place, rows = None, {name.split()[0]: [] for name in _MAPS.split(", ")}

    def close(key):
        for name, value in zip(rows, [*key, *place.state, *place.first, *place.last]):
            rows[name].append(value)

    key = None
    for piece, found, new in _pieces(batches):
        if new:
            if place:
                close(key)
            place, key = _Place(), found
        place.add(piece)
    if place:
        close(key)
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))


def _line_places(batches):
    """Every line with its place; the start is null where the record began in an earlier block."""
    place = None
    for piece, _, new in _pieces(batches):
        if new:
            place = _Place()
        number, found = place.add(piece)
        columns = [piece.column("file"), piece.column("block"), pa.array(number, pa.int64()), piece.column("value")]
        for before, start, whole in found:
            columns += [pa.array(before), pa.array(start, pa.int64(), mask=start < 0), pa.array(whole)]
        yield pa.RecordBatch.from_arrays(columns, [name.split()[0] for name in _LINES.split(", ")])
