"""Records of CSV files whose quoted fields may hold line breaks, read in splits.

A file is read as physical lines, in splits.  Whether a line starts inside quotes depends on
all lines before it, but a line only does one of three things to that state: keep it, turn it
around, or set it.  These compose, so the state is a prefix scan: one scan finds what each split
does, one row each, and a second one goes through the lines of a split with the state at its
start.  Lines that start inside quotes belong to the record before them; a record that crosses
the border of a split is put together in a last step, which only sees records at borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmark.workspace import pin

# One record is one line of text from here on; breaks inside it are written as two marks.
_MARK, _ITSELF, _BREAK, _RETURN = "\ue000", "\ue001", "\ue002", "\ue003"


def _after(line: Column, inside: bool) -> Column:
    """Whether the line ends inside quotes, if it starts inside quotes or not.

    The line is cut at its quotes.  Inside quotes the next one closes.  Outside, a quote opens
    at the start of a field, opens again right behind a closing one (a doubled quote), and is
    an ordinary character anywhere else.
    """
    parts = F.slice(F.split(line, '"', -1), F.lit(1), F.size(F.split(line, '"', -1)) - 1)
    begin = F.struct(
        F.lit(inside).alias("inside"), F.lit(False).alias("closed"), F.lit(True).alias("first")
    )

    def step(state: Column, part: Column) -> Column:
        starts = F.when(part == "", state["first"] | state["closed"]).otherwise(part.endswith(","))
        return F.struct(
            (~state["inside"] & starts).alias("inside"),
            state["inside"].alias("closed"),
            F.lit(False).alias("first"),
        )

    end = F.aggregate(parts, begin, step)["inside"]
    return F.when(F.contains(line, F.lit('"')), end).otherwise(F.lit(inside))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, out, in, line): physical lines in their order, and what each does to the state."""
    line = F.col("value")
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            _after(line, False).alias("out"),
            _after(line, True).alias("in"),
            line.alias("line"),
        )
    )


def _stretches(batch: pa.RecordBatch):
    """(file, block, slice) of neighbouring lines of one split."""
    files, blocks = batch.column("file"), batch.column("block")
    new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()]
    for start, end in zip(starts, [*starts[1:], len(batch)]):
        yield files[start].as_py(), blocks[start].as_py(), batch.slice(start, end - start)


def _flags(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


_SPLIT = "file string, block long, after_out boolean, after_in boolean"


def _splits(batches):
    """Lines (file, block, out, in) to one row a split: the state behind it, by that before it."""
    held = None

    def row():
        return pa.RecordBatch.from_pylist(
            [dict(zip(("file", "block", "after_out", "after_in"), held))],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_())]),
        )

    for batch in batches:
        if not len(batch):
            continue
        for file, block, part in _stretches(batch):
            if held is None or held[:2] != (file, block):
                if held is not None:
                    yield row()
                held = (file, block, False, True)
            out, into = _flags(part, "out", "in")
            held = (file, block, *(bool(_states(out, into, x)[-1]) for x in held[2:]))
    if held is not None:
        yield row()


def _states(out: np.ndarray, into: np.ndarray, state: bool) -> np.ndarray:
    """Whether each line starts inside quotes, and at last the state behind them all.

    A line that ends alike either way sets the state, one that swaps it turns it around.
    """
    turns = np.cumsum(np.r_[0, out & ~into]) & 1
    sets = np.r_[True, out == into]
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), 0))
    value = np.r_[state, out] ^ turns.astype(bool)
    return value[last] ^ turns.astype(bool)


_RECORD = "file string, block long, number long, edge boolean, record string"


def _records(batches):
    """Lines (file, block, out, in, start, line) to (file, block, number, edge, record).

    Number 0 is what goes before the first record of a split, the end of an earlier one.  It and
    the last record of a split are marked as edges: they may belong together.
    """
    held: tuple | None = None  # file, block, state, number of the open record, its lines

    def batch_of(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _RECORD.split(", ")]
        )

    def edge():
        return (held[0], held[1], held[3], True, "\n".join(held[4]))

    for batch in batches:
        if not len(batch):
            continue
        rows = []
        for file, block, part in _stretches(batch):
            if held is None or held[:2] != (file, block):
                if held is not None and held[4]:
                    rows.append(edge())
                held = (file, block, part.column("start")[0].as_py(), 0, [])
            states = _states(*_flags(part, "out", "in"), held[2])
            lines = part.column("line").to_pylist()
            starts = np.flatnonzero(~states[:-1]).tolist()
            open_lines, number = held[4], held[3]
            open_lines += lines[: starts[0] if starts else len(lines)]
            for start, end in zip(starts, [*starts[1:], len(lines)]):
                # Only the lines before the first record, if any, have the number 0.
                if number:
                    rows.append((file, block, number, False, "\n".join(open_lines)))
                elif open_lines:
                    rows.append((file, block, 0, True, "\n".join(open_lines)))
                open_lines, number = lines[start:end], number + 1
            held = (file, block, bool(states[-1]), number, open_lines)
        yield batch_of(rows)
    if held is not None and held[4]:
        yield batch_of([edge()])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, record): the records of all files but the first one of each, the
    header; line breaks inside a record are marked (see ``unmarked``).  Blank records are left out.

    Two scans, both without a shuffle of lines; a task holds a batch of them and one record.
    """
    lines = _lines(spark, path)
    splits = pin(lines.drop("line").mapInArrow(_splits, _SPLIT), "csv-splits")
    # One row a split, in order: a split that sets the state, and how often it was turned since.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("after_out") & ~F.col("after_in"), F.lit(1)).otherwise(F.lit(0))
    turned = F.coalesce(F.sum(turns).over(earlier), F.lit(0)) % 2
    fixed = F.when(
        F.col("after_out") == F.col("after_in"), F.col("after_out").cast("int").bitwiseXOR(F.col("_turned").cast("int"))
    )
    inside = (
        splits.withColumn("_turned", turned)
        .withColumn("_fixed", F.coalesce(F.last(fixed, ignorenulls=True).over(earlier), F.lit(0)))
        .where(F.col("_fixed") != F.col("_turned"))
        .select("file", "block", F.lit(True).alias("start"))
    )
    # Only splits that start inside a record, of which a file of any size has few; the lines keep their order.
    started = lines.join(F.broadcast(pin(inside, "csv-inside")), ["file", "block"], "left").withColumn(
        "start", F.coalesce("start", F.lit(False))
    )
    records = pin(started.mapInArrow(_records, _RECORD), "csv-records")
    # Ends of records go to the last split before theirs in which a record starts.
    until = Window.partitionBy("file").orderBy("block", "number")
    owner = F.when(F.col("number") > 0, F.struct("block", "number"))
    edges = (
        records.where("edge")
        .withColumn("_of", F.last(owner, ignorenulls=True).over(until))
        .groupBy("file", "_of")
        .agg(F.array_sort(F.collect_list(F.struct("block", "number", "record"))).alias("_parts"))
        .select(
            "file", "_of.block", "_of.number",
            F.array_join(F.transform("_parts", lambda x: x["record"]), "\n").alias("record"),
        )
    )
    whole = records.where("NOT edge").drop("edge").unionByName(edges)
    # The CR that ends the record goes; all others are its text.
    text = F.regexp_replace("record", r"\r\z", "")
    for plain, mark in ((_MARK, _ITSELF), ("\n", _BREAK), ("\r", _RETURN)):
        text = F.replace(text, F.lit(plain), F.lit(_MARK + mark))
    header = (F.col("block") == 0) & (F.col("number") == 1)
    return whole.where(~header).select("file", "block", "number", text.alias("record")).where(
        F.trim("record") != ""
    )


def unmarked(text: Column) -> Column:
    """The text of a field as it was."""
    for plain, mark in (("\r", _RETURN), ("\n", _BREAK), (_MARK, _ITSELF)):
        text = F.replace(text, F.lit(_MARK + mark), F.lit(plain))
    return text
