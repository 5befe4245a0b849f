"""Packing documents into token sequences by cutting stock with column generation.

A document is cut into whole sequences and a rest. The histogram of the rests (at most one count for
each length below the sequence's) goes to a linear program whose columns are patterns, the lengths
that share a sequence. Knapsack dynamic programming finds the pattern that the current prices value
most until none improves. Patterns that fill a sequence are used their rounded-down number of times;
documents of a length are ranked and a rank says which pattern, copy and place they get. What
rounding and unfilled patterns leave over forms one stream by length and rank, cut at sequence ends;
its last sequence is cut into powers of two. So nothing is padded.

Ranks come from counts by length and writing task, so no window holds the documents of a length, and
places follow from ranks by arithmetic. Defined results: a null text counts as empty and has only
the end id; rows are packed one by one, so repeated rows, ties and null ids all get their pieces; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gaugeline.llm.bpe import IDS, binary_rows, encode_texts
from gaugeline.llm.text import give_back
from gaugeline.session import settle

#: Counts by task and length up to this many rows (24 bytes each) are broadcast; more are joined.
MOST_COUNTS_SENT = 1_000_000
#: Ids of a batch that are cut at once.
CUT_IDS = 1 << 20


def knapsack(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths that fits, as a count for each length."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(lengths)
    ordered, worth = lengths[order], values[order]
    for room in range(1, size + 1):
        best[room], last[room] = best[room - 1], -1
        fits = int(np.searchsorted(ordered, room, "right"))
        if fits:
            options = worth[:fits] + best[room - ordered[:fits]]
            k = int(options.argmax())
            if options[k] > best[room] + 1e-12:
                best[room], last[room] = options[k], order[k]
    counts, room = np.zeros(len(lengths), dtype=np.int64), size
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(lengths[last[room]])
    return float(best[size]), counts


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 0.002,
                  most_rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(counts by length, times): patterns and how often to use them, rounded down.

    Solves min sum(x) with every length covered, by the revised simplex method on the patterns made
    so far; stops when the bound from the prices shows less than `gap` to gain, or after so many
    rounds. The plan is then whole all the same, and what it leaves over is not lost.
    """
    m = len(lengths)
    if not m:
        return []
    index = {int(r): i for i, r in enumerate(lengths)}
    columns = np.zeros((m, m))
    for i, r in enumerate(lengths.tolist()):
        other = index.get(size - r)
        # Pair a length with what fills it up; the scarcer of the two sets how often.
        if other is None or other == i or demand[i] > demand[other] or (
                demand[i] == demand[other] and i > other):
            columns[i, i] = size // r
        else:
            columns[i, i] = columns[other, i] = 1
    inverse = np.linalg.inv(columns)
    times = inverse @ demand
    for _ in range(most_rounds):
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(prices, lengths, size)
        total = times.sum()
        if value <= 1 + 1e-9 or total - total / value <= gap * total:
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, times / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        times = times - ratio[out] * direction
        times[out] = ratio[out]
        columns[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    found, left = [], demand.astype(np.int64).copy()
    for i in np.argsort(-times, kind="stable").tolist():
        pattern = np.rint(columns[:, i]).astype(np.int64)
        used = pattern > 0
        n = min(int(np.floor(times[i] + 1e-6)), int((left[used] // pattern[used]).min()))
        if n > 0:
            left -= n * pattern
            found.append((pattern, n))
    return found


@dataclass(frozen=True)
class Places:
    """Where the rest of length r and rank k goes; a few numbers for each length and pattern.

    Entry j serves ranks `first[j]` up to the next entry's of the same length, `copies[j]` in each
    sequence from `sequence[j]` on, the first of them at `offset[j]`. Later ranks go to the stream.
    """

    size: int
    key: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    stream: np.ndarray
    patterns: int
    ends: np.ndarray
    whole: int

    def parts(self, length: np.ndarray, rank: np.ndarray):
        """(which rest, length, sequence, offset) of the rests' parts in order; sequences from 0."""
        which, parts, sequence, offset = [], [], [], []
        packed = rank < self.used[length]
        at = np.flatnonzero(packed)
        if len(at):
            j = np.searchsorted(self.key, length[at] * (1 << 40) + rank[at], "right") - 1
            copy, place = np.divmod(rank[at] - self.first[j], self.copies[j])
            which.append(at)
            parts.append(length[at])
            sequence.append(self.sequence[j] + copy)
            offset.append(self.offset[j] + place * length[at])
        at = np.flatnonzero(~packed)
        if len(at):
            start = self.stream[length[at]] + (rank[at] - self.used[length[at]]) * length[at]
            stop = start + length[at]
            cut = self.whole * self.size
            while len(at):
                tail = start >= cut
                k = np.searchsorted(self.ends, start, "right")
                end = np.where(tail, self.ends[np.minimum(k, len(self.ends) - 1)] if len(self.ends) else stop,
                               (start // self.size + 1) * self.size)
                begin = np.where(tail, np.where(k > 0, self.ends[np.maximum(k - 1, 0)] if len(self.ends) else cut, cut),
                                 start // self.size * self.size)
                begin = np.where(tail & (k == 0), cut, begin)
                to = np.minimum(stop, end)
                which.append(at)
                parts.append(to - start)
                sequence.append(self.patterns + np.where(tail, self.whole + k, start // self.size))
                offset.append(start - begin)
                more = to < stop
                at, start, stop = at[more], to[more], stop[more]
        if not which:
            return (np.zeros(0, dtype=np.int64),) * 4
        level = np.concatenate([np.full(len(w), i) for i, w in enumerate(which)])
        which, parts, sequence, offset = map(np.concatenate, (which, parts, sequence, offset))
        order = np.lexsort((level, which))
        return which[order], parts[order], sequence[order], offset[order]


def places(histogram: dict[int, int], size: int) -> Places:
    """The plan for rests with this many documents of each length."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[r] for r in lengths.tolist()], dtype=np.int64)
    key, first, copies, sequence, offset = [], [], [], [], []
    used = np.zeros(size, dtype=np.int64)
    made = 0
    for pattern, times in cutting_stock(lengths, demand, size):
        if pattern @ lengths != size:
            continue  # not filled: its documents go to the stream instead of beside padding
        at = 0
        for i in np.flatnonzero(pattern).tolist():
            r, n = int(lengths[i]), int(pattern[i])
            key.append(r * (1 << 40) + int(used[r]))
            first.append(int(used[r]))
            copies.append(n)
            sequence.append(made)
            offset.append(at)
            used[r] += n * times
            at += n * r
        made += times
    stream, total = np.zeros(size, dtype=np.int64), 0
    for r, n in zip(lengths.tolist(), demand.tolist()):
        stream[r] = total
        total += (n - int(used[r])) * r
    whole, rest = divmod(total, size)
    ends, at = [], whole * size
    for bit in range(size.bit_length(), -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    order = np.argsort(np.array(key, dtype=np.int64))
    arrays = [np.array(x, dtype=np.int64)[order] for x in (key, first, copies, sequence, offset)]
    return Places(size, *arrays, used, stream, made, np.array(ends, dtype=np.int64), whole)


def pack(
    df: DataFrame, path: str, end_id: int = 0, size: int = 1024, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece of all documents.

    `ids` are little-endian unsigned 32-bit. Every sequence is full or a power of two long. Between
    its steps ids take two bytes where the vocabulary and `end_id` fit in them, else four.
    """
    # The largest id, not the number of them: added tokens may leave gaps.
    largest = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    narrow = np.dtype("<u2" if largest < 1 << 16 else "<u4")
    kind = T.StructField("doc_id", df.schema[doc_id].dataType)
    written = T.StructType([
        kind, T.StructField("block", T.IntegerType()), T.StructField("rest", T.IntegerType()),
        T.StructField("place", T.LongType()), T.StructField("whole_before", T.LongType()),
        T.StructField("tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([end_id], dtype=narrow).tobytes()

    def numbered(batches):
        block, seen, whole = TaskContext.get().partitionId(), np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            column = pa.array([x.as_py() + end for x in batch.column(1)], pa.large_binary())
            tokens = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[:len(column) + 1]) // narrow.itemsize
            rest = tokens % size
            order = np.argsort(rest, kind="stable")
            own = np.bincount(rest, minlength=size)
            place = np.empty(len(rest), dtype=np.int64)
            place[order] = np.arange(len(rest)) - np.repeat(np.cumsum(own) - own, own) + seen[rest[order]]
            seen += own
            wholes = np.cumsum(tokens // size)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(rest), block, dtype=np.int32)),
                pa.array(rest.astype(np.int32)), pa.array(place),
                pa.array(whole + wholes - tokens // size), pa.array(tokens), column.cast(pa.binary()),
            ], names=written.names)
            whole += int(wholes[-1]) if len(wholes) else 0

    table = settle(encode_texts(df, path, text, (doc_id,), id_bytes=narrow.itemsize, then=(numbered, written)))
    counts = settle(table.groupBy("block", "rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("tokens") / size)).alias("wholes")))
    histogram = {r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    whole = counts.agg(F.sum("wholes")).first()[0] or 0
    plan = places({r: n for r, n in histogram.items() if r}, size)

    before = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each writing task.
    by_block = counts.groupBy("block").agg(F.sum("wholes").alias("wholes"))
    so_far = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = by_block.select("block", F.coalesce(F.sum("wholes").over(so_far), F.lit(0)).alias("first_whole"))
    bases = counts.select("block", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    bases = settle(bases.join(by_block, "block"))
    if bases.count() <= MOST_COUNTS_SENT:
        bases = F.broadcast(bases)
    ranked = table.join(bases, ["block", "rest"]).select(
        "doc_id", (F.col("first_whole") + F.col("whole_before")).alias("whole"), "rest",
        (F.col("first_rank") + F.col("place")).alias("rank"), "tokens", "ids")
    schema = T.StructType([
        kind, *[T.StructField(c, T.LongType()) for c in
                ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()),
    ])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        first_whole, rest, rank, tokens = (batch.column(i).to_numpy() for i in range(1, 5))
        n, rest = len(tokens), rest.astype(np.int64)
        wholes = tokens // size
        at = np.flatnonzero(rest)
        doc, part, sequence, offset = plan.parts(rest[at], rank[at])
        doc = np.concatenate([np.repeat(np.arange(n), wholes), at[doc]])
        index = np.arange(int(wholes.sum())) - np.repeat(np.cumsum(wholes) - wholes, wholes)
        length = np.concatenate([np.full(len(index), size), part])
        sequence = np.concatenate([np.repeat(first_whole, wholes) + index, whole + sequence])
        offset = np.concatenate([np.zeros(len(index), dtype=np.int64), offset])
        order = np.argsort(doc, kind="stable")
        doc, length, sequence, offset = doc[order], length[order], sequence[order], offset[order]
        ends = np.concatenate([[0], np.cumsum(length)])
        start = ends[:-1] - (np.cumsum(tokens) - tokens)[doc]
        raw = np.concatenate([np.frombuffer(x.as_buffer(), dtype=narrow) for x in batch.column(5)])
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]),
            pa.array(sequence), pa.array(offset), binary_rows(raw.astype(IDS), ends)], names=schema.names)

    def pieces(batches):
        for batch in batches:
            total = np.cumsum(batch.column(4).to_numpy())
            at = 0
            while at < batch.num_rows:
                done = total[at - 1] if at else 0
                to = max(int(np.searchsorted(total, done + CUT_IDS, "right")), at + 1)
                yield cut(batch.slice(at, to - at))
                at = to
            give_back()

    return ranked.mapInArrow(pieces, schema)
