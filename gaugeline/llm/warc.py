"""WARC records as a table of chunks: a record is its header, payload pieces and closing lines.

Rows are (record, chunk_no, data): chunk 0 is the header, 1 to n are payload pieces of at most
`chunk_bytes`, the last is the blank lines after the block. Put together in order they are the bytes
of a WARC/1.1 file. Payload rows carry the SHA-1 of the payload up to and with themselves, so a
reader streams a record of any size, stops at the first bad piece and never holds the record.
Payloads met before become revisit records without a block.

Payloads stay where they are. Writing scans twice: the first scan finds the payloads that several
pages share, by digest, and that list is sent to the second while it is small. Reading takes the
file splits as they lie and finishes every record that begins and ends in one; only the records that
a split cuts in two are read again and brought together.

Defined results: a null payload is empty; a null page id is written as `null`, is never the larger
one, and reads back as null; of rows with one page id and equal payloads, all that have the largest
page id are responses; a null url leaves its header line out; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.session import settle

CHUNK_BYTES = 1 << 16
#: Shared payloads (digest, length, page: some 60 bytes) up to which their list is sent to all tasks.
SENT_PAYLOADS = 1_000_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = hashlib.sha1(b"").digest()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five bytes (eight letters) at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def chunk_table(
    df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
    chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    sent_payloads: int = SENT_PAYLOADS,
) -> DataFrame:
    """(record, chunk_no, data, running_sha1) of one WARC record for each row.

    Payloads that several pages share are counted first. More of them than `sent_payloads` are joined
    by digest instead, which moves each payload once; Spark then splits the copies of a hot one.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.monotonically_increasing_id().alias("record"),
        F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").alias("uri"),
        body.alias("payload"),
    ).withColumns({"n": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    shared = settle(
        rows.where(F.col("n") >= least_bytes).groupBy("digest", "n")
        .agg(F.max("page").alias("latest"), F.min("page").alias("least"), F.count_if(F.col("page").isNull()).alias("nulls"))
        .where((F.col("least") < F.col("latest")) | F.col("latest").isNotNull() & (F.col("nulls") > 0))
        .select("digest", "n", "latest"))
    rows = rows.join(F.broadcast(shared) if shared.count() <= sent_payloads else shared, ["digest", "n"], "left")
    again = F.coalesce(F.col("latest") > F.col("page"), F.col("page").isNull() & F.col("latest").isNotNull())
    stored = F.when(again, 0).otherwise(F.col("n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(_line("WARC-Refers-To", _urn(F.col("latest"))),
                               _line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        _line("X-Payload-Length", F.col("n")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", stored),
        F.lit("\r\n"),
    ).cast("binary")
    rows = rows.select("record", header.alias("header"), F.when(~again, F.col("payload")).alias("payload"),
                       F.ceil(stored / chunk_bytes).cast("int").alias("pieces"))
    no = F.col("chunk_no")
    # Pieces are cut in the JVM, so no Python worker is handed a whole payload.
    chunks = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") + 1)).alias("chunk_no")).select(
        "record", "chunk_no",
        F.when(no == 0, F.col("header"))
        .when(no <= F.col("pieces"), F.substring("payload", (no - 1) * chunk_bytes + 1, F.lit(chunk_bytes)))
        .otherwise(F.lit("\r\n\r\n").cast("binary")).alias("data"),
        ((no > 0) & (no <= F.col("pieces"))).alias("is_payload"),
    )
    schema = T.StructType([
        T.StructField("record", T.LongType()), T.StructField("chunk_no", T.IntegerType()),
        T.StructField("data", T.BinaryType()), T.StructField("running_sha1", T.BinaryType()),
    ])

    def digested(batches):
        running = hashlib.sha1()
        for batch in batches:
            out = []
            for no, data, own in zip(batch.column(1), batch.column(2), batch.column(3)):
                if no.as_py() == 0:
                    running = hashlib.sha1()
                if own.as_py():
                    running.update(memoryview(data.as_buffer()))
                out.append(running.digest() if own.as_py() else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.binary())], names=schema.names)

    return chunks.mapInArrow(digested, schema)


_FIELD = re.compile(rb"^([^:\r\n]+): ([^\r\n]*)\r$", re.M)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of a written chunk table, from its header and a check of its payload.

    A task streams its splits and leaves a record that it does not see whole, from the header to the
    closing lines, to a second pass over these records alone: at most two a split, so their numbers
    are sent to all tasks. Raises on a piece out of order, a length or a digest that does not hold.
    """
    chunks = spark.read.parquet(folder).select("record", "chunk_no", "data", "running_sha1")
    found = settle(chunks.mapInArrow(_records(whole=False), _READ))
    out = found.where("left_over IS NULL").drop("left_over")
    cut = found.where("left_over IS NOT NULL").select(F.col("left_over").alias("record")).distinct()
    if cut.isEmpty():
        return out
    again = chunks.join(F.broadcast(cut), "record", "left_semi")
    again = again.repartition("record").sortWithinPartitions("record", "chunk_no")
    return out.unionByName(again.mapInArrow(_records(whole=True), _READ).drop("left_over"))


_READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("target_uri", T.StringType()),
    T.StructField("left_over", T.LongType()),
])
_READ_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _page_of(urn: str | None) -> int | None:
    name = (urn or "null").strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def _finished(head: dict[str, str], length: int, sha: bytes) -> tuple:
    stored = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if length != int(head["Content-Length"]):
        raise ValueError(f"{head['WARC-Record-ID']}: {length} bytes, {head['Content-Length']} stated")
    if head["WARC-Type"] == "response" and base64.b32encode(sha).decode() != stored:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
    return (_page_of(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), stored, head["WARC-Type"],
            _page_of(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), None)


def _records(whole: bool):
    """Reads chunks in order; `whole` says that every record must be complete."""

    def run(batches):
        # The record being read, its last chunk, header, digest so far and length so far.
        now, last, head, running, length, out = None, -1, None, None, 0, []

        def leave(record: int) -> None:
            if whole:
                raise ValueError(f"record {record}: chunks are missing after {last}")
            out.append((*[None] * 6, record))

        for batch in batches:
            for record, no, data, sha in zip(*(batch.column(i) for i in range(4))):
                record, no = record.as_py(), no.as_py()
                if now is not None and (record != now or no != last + 1):
                    leave(now)
                    now = None
                if no == 0:
                    now, running, length = record, hashlib.sha1(), 0
                    head = {k.decode(): v.decode() for k, v in _FIELD.findall(data.as_py())}
                elif now is None:
                    if whole:
                        raise ValueError(f"record {record}: begins with chunk {no}")
                    # Its beginning is elsewhere.
                    if not out or out[-1][-1] != record:
                        out.append((*[None] * 6, record))
                elif sha.is_valid:
                    piece = memoryview(data.as_buffer())
                    running.update(piece)
                    length += len(piece)
                    if running.digest() != sha.as_py():
                        raise ValueError(f"record {record}: chunk {no} does not match its digest")
                else:
                    out.append(_finished(head, length, running.digest()))
                    now = None
                last = no
            yield _read_batch(out)
            out.clear()
        if now is not None:
            leave(now)
            yield _read_batch(out)

    return run


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_READ_TYPES)], names=_READ.names)


def write_archive(df: DataFrame, folder: str, **options) -> str:
    """The chunk table of `df` (see `chunk_table`), written as Parquet."""
    chunk_table(df, **options).write.parquet(folder)
    return folder
