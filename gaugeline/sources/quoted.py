"""CSV files whose quoted cells hold line breaks, read by several tasks.

A task that starts in the middle of a file cannot tell whether it stands inside a quoted cell. So the
lines are read twice. First each file split tells what it does to a reader that comes in outside a cell
and to one that comes in inside; these are a few bytes a split, and a running window over the splits of a
file gives each the state it starts in. Then each split puts its lines together to records. Only the
pieces of records that a split border cuts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions.time import quoted

_SPLIT = "path string, begin bigint"
# What a text is: a whole record, the rest of one that began in an earlier split, the first piece of one
# that the split's end cuts, the first piece of such a header.
WHOLE, REST, FIRST, HEADER = range(4)


def csv_records(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """The records of CSV files as texts in `value`, without the header record of each file.

    Cells are divided by commas; a quote opens a cell only at its start and is doubled inside. Lines end in
    a line feed, with or without a carriage return before it; inside a cell both become a line feed. Empty
    lines between records are left out. A cell that is never closed takes the rest of its file.
    """
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value")
    parts = lines.mapInArrow(_effects, f"{_SPLIT}, outside boolean, inside boolean")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    # A split sets the state, keeps it or turns it round; what counts is the last one that sets it, and
    # how many turned it round since.
    turned = F.count_if(F.col("outside") & ~F.col("inside"))
    upto = Window.partitionBy("path").orderBy("begin")
    marked = parts.withColumn("turns", turned.over(upto))
    sets = F.when(F.col("outside") == F.col("inside"), F.struct("begin", "outside", "turns"))
    last = F.max(sets).over(before)
    turns = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    starts = marked.select(
        "path", "begin",
        F.when(turns % 2 == 1, ~F.coalesce(last["outside"], F.lit(False)))
        .otherwise(F.coalesce(last["outside"], F.lit(False))).alias("open"))
    # One small row a split: Spark's driver holds a larger one for each when it plans the scan.
    placed = lines.join(F.broadcast(starts), ["path", "begin"])
    found = placed.mapInArrow(_records, f"{_SPLIT}, place int, value string")
    whole = found.where(F.col("place") == WHOLE).select("value")
    return whole.unionByName(_joined(found.where(F.col("place") != WHOLE))).where("value <> ''")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that split borders cut: a first piece, and rests of later splits up to the next first."""
    starts = F.col("place") != REST
    upto = Window.partitionBy("path").orderBy("begin", starts)
    numbered = pieces.withColumn("record", F.count_if(starts).over(upto))
    texts = F.array_sort(F.collect_list(F.struct("begin", "value")))
    grouped = numbered.groupBy("path", "record").agg(texts.alias("parts"), F.max("place").alias("place"))
    return grouped.where(F.col("place") != HEADER).select(
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line lies inside a quoted cell, by whether its start does."""
    closed, first = False, not inside
    *pieces, _ = line.split('"')
    for piece in pieces:
        if inside:
            inside, closed = False, True
        else:
            # Doubled inside a cell, or at the start of one; else the quote is a sign like others.
            inside = not piece if closed or first else piece.endswith(",")
            inside = inside or piece.endswith(",")
            closed = False
        first = False
    return inside


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Stretches of a batch that are of one split: path, begin, from, to."""
    if not batch.num_rows:
        return
    path = batch.column("path").dictionary_encode()
    codes, begins = path.indices.to_numpy(), batch.column("begin").to_numpy()
    borders = np.flatnonzero((np.diff(codes) != 0) | (np.diff(begins) != 0)) + 1
    for a, b in pairwise([0, *borders.tolist(), batch.num_rows]):
        yield path.dictionary[int(codes[a])].as_py(), int(begins[a]), a, b


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the state at its end, by the state at its start."""
    now, states = None, [False, True]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *states)],
                                          ["path", "begin", "outside", "inside"])

    for batch in batches:
        for path, begin, a, b in _runs(batch):
            if now != (path, begin):
                if now:
                    yield row()
                now, states = (path, begin), [False, True]
            lines = batch.column("value").slice(a, b - a)
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                states = [ends_inside(line, s) for s in states]
    if now:
        yield row()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines put together to records, or to the pieces of them that lie in a split; no whole header."""
    now, held, rest, inside, header = None, [], False, False, False
    out: list[tuple[str, int, int, str]] = []

    def finish(kind: int) -> None:
        nonlocal held, rest, header
        text, held, rest = "\n".join(held), [], False
        if not header:
            out.append((*now, kind, text))
        elif kind == FIRST:
            out.append((*now, HEADER, text))
        # Empty lines may stand before the header.
        header = header and not text

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["path", "begin", "place", "value"])

    for batch in batches:
        for path, begin, a, b in _runs(batch):
            if now != (path, begin):
                if held:
                    finish(REST if rest else FIRST)
                now, header = (path, begin), begin == 0
                inside = rest = batch.column("open")[a].as_py()
            for line in batch.column("value").slice(a, b - a).to_pylist():
                held.append(line.removesuffix("\r"))
                if '"' in line:
                    inside = ends_inside(held[-1], inside)
                if not inside:
                    finish(REST if rest else WHOLE)
        yield flush()
    if held:
        finish(REST if rest else FIRST)
    yield flush()


def cells(records: DataFrame, names: list[str]) -> DataFrame:
    """The records' cells as text columns; only an empty cell without quotes is missing."""
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    parsed = records.select(F.from_csv("value", schema, {"escape": '"'}).alias("r"))
    return parsed.select("r.*")
