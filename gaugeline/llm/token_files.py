"""Token ids as Parquet list columns: in id order, with small pages and page indexes.

A row holds a document's id, the number of its ids, how many ids lie before it in its part, and the
ids as a list. List values come from a bounded vocabulary and are dictionary-encoded; the ascending
columns are delta-encoded. Row groups and pages are small and Parquet keeps an index of the pages,
so a reader fetches the counts without the ids, or the ids of a few documents without the rest.

Defined results: a null text counts as empty and has only the end id; null document ids come first;
rows with equal document ids follow one another, ordered by their texts; an empty table gives files
without rows; columns other than the two named are not written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.bpe import IDS, STORED_WORDS, encoder_for
from gaugeline.llm.text import give_back, texts_of
from gaugeline.session import settle

#: Part totals up to so many rows (16 bytes each) are sent to all executors; more are joined.
MOST_PARTS_SENT = 1 << 20

LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}


def write_token_files(
    df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    layout: dict[str, str] | None = None, stored_words: int = STORED_WORDS,
) -> str:
    """Writes the ids of all texts, each with `end_id` after it, in ascending `doc_id` order."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"),
                    F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    # The hash lets many rows of one document id be dealt to several parts.
    own = own.select("doc_id", F.xxhash64("body").alias("tie"), "body")
    own = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "body")
    schema = T.StructType([
        own.schema["doc_id"], T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])

    def rows(batches):
        encoder = encoder_for(path, stored_words)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for texts in texts_of(batch.column(2)):
                ids, offsets = encoder.encode(texts)
                ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                offsets = offsets + np.arange(len(offsets))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, len(texts)),
                    pa.array(np.full(len(texts), part, dtype=np.int32)),
                    pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ], names=schema.names)
                before += int(offsets[-1])
        give_back()

    own.mapInArrow(rows, schema).write.options(**(LAYOUT | (layout or {}))).parquet(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files with `start`, the ids of all documents before; unread columns stay unread."""
    files = spark.read.parquet(folder)
    totals = settle(files.groupBy("part").agg(F.sum("n_tokens").alias("tokens")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part: as many as the writer had tasks, not rows.
    bases = totals.select(F.col("part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    if totals.count() <= MOST_PARTS_SENT:
        bases = F.broadcast(bases)
    return files.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_crc32(df: DataFrame, ids: str = "ids") -> DataFrame:
    """`ids` replaced by `ids_crc32`, of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    own = df.select(*[c for c in df.columns if c != ids], ids)
    schema = T.StructType(own.schema.fields[:-1] + [T.StructField("ids_crc32", T.LongType())])

    def rows(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            raw = memoryview(np.ascontiguousarray(
                lists.values.to_numpy(zero_copy_only=False), dtype=IDS)).cast("B")
            ends = lists.offsets.to_numpy() * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    return own.mapInArrow(rows, schema)
