"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, a word is a run of letters and digits of ASCII and
of all other characters. A benchmark item gives its windows of `size` consecutive words, or itself
if it has fewer. The automaton runs over words, not characters: each word of the items is a symbol,
and a document is read once, stretch by stretch of words that are symbols at all. Places are kept
beside the words, so what is found is told in code points of the original text.

Defined results: a null text has no words; an item without words has no window; a null item id is
the text `null`; rows with one item id are one item; each row of the documents gives one row, rows
with equal ids too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.text import LOWER, Texts, byte_set, run_hashes, runs, texts_of
from gaugeline.session import settle

#: Bytes of benchmark text in one automaton; a larger benchmark is searched in blocks of items.
BLOCK_BYTES = 1 << 20

_BREAKS = byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))


def _words(texts: Texts):
    data = LOWER[texts.data]
    found = runs(texts, _BREAKS, data)
    return found, run_hashes(data, found)


class Windows:
    """The windows of some items: their words, and an automaton made once in each worker."""

    def __init__(self, ids: list[str], texts: list[str | None], size: int):
        own = []
        for part in texts_of(pa.array(texts, pa.string())):
            found, hashes = _words(part)
            ends = np.searchsorted(found.text, np.arange(len(part) + 1))
            own += [(part.first + i, hashes[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        self.vocabulary = np.unique(np.concatenate([h for _, h in own])) if own else np.zeros(0, np.uint64)
        holders = defaultdict(set)
        for item, hashes in own:
            symbols = np.searchsorted(self.vocabulary, hashes).tolist()
            width = min(size, len(symbols))
            for i in range(len(symbols) - width + 1):
                holders[tuple(symbols[i:i + width])].add(ids[item])
        self.keys = list(holders)
        self.items = [tuple(sorted(holders[k])) for k in self.keys]
        self.least = min(map(len, self.keys), default=0)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for number, key in enumerate(self.keys):
                made.add_word(key, (len(key), number))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def occurrences(self, hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, window) of every window in the words of some texts."""
        if not self.keys or not len(hashes):
            return
        symbol = np.searchsorted(self.vocabulary, hashes)
        symbol[symbol == len(self.vocabulary)] = 0
        known = self.vocabulary[symbol] == hashes
        linked = known[1:] & known[:-1] & (text[1:] == text[:-1])
        start = np.flatnonzero(known & ~np.concatenate([[False], linked]))
        end = np.flatnonzero(known & ~np.concatenate([linked, [False]])) + 1
        long = end - start >= self.least
        find = self.automaton().iter
        for a, b in zip(start[long].tolist(), end[long].tolist()):
            for last, (width, window) in find(tuple(symbol[a:b].tolist())):
                yield a + last + 1 - width, a + last + 1, window


def _scanned(texts: Texts, windows: Windows):
    """Numbers of words, items and spans of hit words of each text."""
    found, hashes = _words(texts)
    n_words = np.bincount(found.text, minlength=len(texts))
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in range(len(texts))]
    seen = set()
    for a, b, window in windows.occurrences(hashes, found.text):
        edge[a] += 1
        edge[b] -= 1
        seen.add((int(found.text[a]), window))
    for i, window in seen:
        items[i].update(windows.items[window])
    spans: list[list] = [[] for _ in range(len(texts))]
    if seen:
        hit = np.cumsum(edge[:-1]) > 0
        same = hit[1:] & hit[:-1] & (found.text[1:] == found.text[:-1])
        first = np.flatnonzero(hit & ~np.concatenate([[False], same]))
        last = np.flatnonzero(hit & ~np.concatenate([same, [False]]))
        # Code points before a byte: all bytes but those that continue one.
        points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        for a, b in zip(first.tolist(), last.tolist()):
            i = int(found.text[a])
            base, zero = int(first_word[i]), int(points[texts.offsets[i]])
            spans[i].append({"first": a - base, "last": b - base,
                             "start": int(points[found.start[a]]) - zero, "end": int(points[found.end[b]]) - zero})
    return n_words, [sorted(x) for x in items], spans


def _scan(df: DataFrame, id_type: str, windows: Windows) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(windows)
    names = ["id", "n_words", "items", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                n_words, items, spans = _scanned(texts, sent.value)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, len(texts)), pa.array(n_words, pa.int64()),
                    pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)], names=names)

    return df.mapInArrow(run, f"id {id_type}, n_words long, items array<string>, spans {_SPANS}")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks put together: those that overlap or touch become one."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
                if merged and s["first"] <= merged[-1]["last"] + 1:
                    if s["last"] > merged[-1]["last"]:
                        merged[-1].update(last=s["last"], end=s["end"])
                else:
                    merged.append(s)
            out.append(merged)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, batch.schema.field("spans").name, pa.array(out, _SPAN_TYPE))


def contamination(
    df: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each document `n_words`, `n_hit`, `items` (ids as text, in order) and `spans` of hit words.

    A word is hit if it lies in an occurrence of any window. A span holds its first and last word and
    its code points, end exclusive. The benchmark's bytes are counted first: up to `block_bytes` make
    one automaton, which is sent to all workers; a larger benchmark is dealt by item to blocks of about
    that size, the documents are read once for each, and what the blocks found is put together.
    """
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("id"),
        F.col(f"`{item_text}`").alias("text"))
    bytes_ = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-bytes_ // block_bytes))
    docs = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def windows(block: int) -> Windows:
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = own.collect()
        return Windows([r["id"] for r in rows], [r["text"] for r in rows], size)

    if blocks == 1:
        found = _scan(docs, kind, windows(0))
    else:
        docs = settle(docs.withColumn("row", F.monotonically_increasing_id()))
        whole = None
        for block in range(blocks):
            part = settle(_scan(docs.select("row", "text"), "long", windows(block)))
            whole = part if whole is None else whole.union(part)
        by_row = whole.groupBy("id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("spans")).alias("spans"))
        by_row = by_row.mapInArrow(_united, by_row.schema).withColumnRenamed("id", "row")
        found = by_row.join(docs.select("row", "id"), "row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return found.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), "items", "spans")
