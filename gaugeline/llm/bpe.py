"""Byte-pair encoding and decoding of whole texts, long texts as a tree of halves.

A text is encoded word by word with a bounded store of words met before. A text longer than
`chunk_chars` is cut into halves, these again, until all are short; the parts are encoded in
parallel as rows of their own. Neighbours are then joined pair by pair up the tree: the ids around
a join are decoded and encoded again in a window that grows until its first ids agree with the left
side and its last ids with the right side. From there on both sides are what the whole text gives.
A cut between words needs no window.

Ids travel as binary, little-endian unsigned 32-bit. Defined results: a null text counts as empty,
an empty text has no ids; rows are independent, so repeated rows, ties and null keys give a row
each; a special token's text gets its special id, as the library does.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.text import BLANKS, Runs, Texts, byte_set, give_back, run_hashes, texts_of

IDS = np.dtype("<u4")
#: Texts of more characters are cut into halves.
CHUNK_CHARS = 32768
#: Words whose ids a worker keeps, about 30 bytes each; the ones not met for a while go first.
STORED_WORDS = 1_200_000
#: Words the library is given at once; it keeps some 200 bytes for each id meanwhile.
ASKED_WORDS = 4096
#: Ids on each side of a join that are encoded again at first.
WINDOW = 16
#: Ids of the smallest window around a join.
LEAST_WINDOW = 16

# The characters that end a word for the library's expressions.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[^{_BLANK}] (?=[^{_BLANK}])")

_PLAIN = byte_set(bytes(range(128))) & ~BLANKS
# First bytes of characters that are no blanks for sure, and of two-byte ones among them.
_NO_BLANK = _PLAIN | byte_set(bytes(b for b in range(0xC3, 0xF8) if b not in (0xE1, 0xE2, 0xE3)))
_TWO = byte_set(bytes(range(0xC3, 0xE0)))
# A mark behind an ASCII letter or digit begins a token of its own in both kinds of vocabulary.
_ALNUM = byte_set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARKS = byte_set(b".,;:!?|")


def plain_words(texts: Texts) -> Runs:
    """Words between ASCII blanks, a mark that follows a letter or digit cut off with what follows."""
    data, n = texts.data, len(texts.data)
    if not n:
        return Runs(*(np.zeros(0, dtype=np.int64),) * 3)
    edge = np.zeros(n, dtype=bool)
    edge[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    blank = BLANKS[data]
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    bound = blank | edge | BLANKS[before] | (_MARKS[data] & _ALNUM[before])
    bound[0] = True
    at = np.flatnonzero(bound)
    end = np.append(at[1:], n)
    words = ~blank[at]
    start = at[words]
    return Runs(start, end[words], np.searchsorted(texts.offsets, start, "right") - 1)


def spaced_words(texts: Texts) -> Runs:
    """Stretches of text that a byte-level encoding treats alike wherever they stand.

    They begin with the blank before a word. Of a longer run of blanks the last blank goes with the
    word if it is a space; the others stay together. Where a neighbour may be a blank outside ASCII
    nothing is cut, which only makes a longer stretch.
    """
    data, n = texts.data, len(texts.data)
    if not n:
        return Runs(*(np.zeros(0, dtype=np.int64),) * 3)
    edge = np.zeros(n, dtype=bool)
    edge[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    blank = BLANKS[data]
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    word_before = _PLAIN[before] | np.concatenate([[False, False], _TWO[data[:-2]]])[:n]
    word_after = np.concatenate([_NO_BLANK[data[1:]], [False]])
    cut = blank & word_before | (data == 32) & word_after
    cut |= _MARKS[data] & _ALNUM[before]
    # A single line feed between two words stands alone.
    lone = (data == 10) & word_before & word_after & ~edge
    cut[1:] |= lone[:-1]
    start = np.flatnonzero(cut | edge)
    return Runs(start, np.append(start[1:], n), np.searchsorted(texts.offsets, start, "right") - 1)


class Store:
    """Ids of words by the words' 64-bit hashes, in sorted arrays; bounded."""

    def __init__(self, most: int, kind: type = np.uint32) -> None:
        self.most, self.fresh_most = most, max(most // 16, 1)
        self.main = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.fresh = self.main
        self.used = np.zeros(0, dtype=bool)
        self.pool = np.zeros(1 << 16, dtype=kind)
        self.filled = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, place in the pool, number of ids) of each hash."""
        known = np.zeros(len(hashes), dtype=bool)
        place, count = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for k, (keys, at, n) in enumerate((self.main, self.fresh)):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[i] == hashes
                place[hit], count[hit] = at[i[hit]], n[i[hit]]
                known |= hit
                if k == 0:
                    self.used[i[hit]] = True
        return known, place, count

    def put(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Places of new words' ids, which are given one after another."""
        if self.filled + len(ids) > len(self.pool):
            grown = np.zeros(max(len(self.pool) * 3 // 2, self.filled + len(ids)), dtype=self.pool.dtype)
            grown[:self.filled] = self.pool[:self.filled]
            self.pool = grown
        self.pool[self.filled:self.filled + len(ids)] = ids
        place = self.filled + np.cumsum(count) - count
        self.filled += len(ids)
        return place

    def add(self, hashes: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
        """New hashes, ascending, whose ids have been put; may move the pool."""
        self.fresh = self._merged(self.fresh, (hashes, place, count.astype(np.int32)))[0]
        if len(self.fresh[0]) > self.fresh_most:
            self.main, order, old = self._merged(self.main, self.fresh)
            self.used = np.concatenate([self.used, np.ones(len(order) - old, dtype=bool)])[order]
            self.fresh = tuple(x[:0] for x in self.main)
            if len(self.main[0]) > self.most:
                self._forget()

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b)), order, len(a[0])

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used)
        if len(keep) > self.most // 2:
            keep = keep[:: -(-2 * len(keep) // self.most)]
        keys, place, count = (x[keep] for x in self.main)
        ids = self.pool[ranges(place, count)]
        self.pool, self.filled = ids, len(ids)
        self.main = keys, np.cumsum(count, dtype=np.int64) - count, count
        self.used = np.zeros(len(keys), dtype=bool)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), then the same for the others."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Encoder:
    """Whole texts to ids of one tokenizer file, word by word."""

    def __init__(self, path: str, stored_words: int = STORED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shape = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in shape["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.first_bytes = byte_set(bytes({s.encode()[0] for s in special}))
        self.mark = special[-1] if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if special else None
        #: Whether blanks are part of the ids, so that ids decode to the text.
        self.keeps_blanks = (shape["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.store = Store(stored_words, np.uint16 if small else np.uint32)
        self._bytes: tuple[np.ndarray, np.ndarray] | None = None

    def whole(self, text: str) -> bytes:
        return self._whole(text).tobytes()

    def _whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=IDS)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if len(words) > ASKED_WORDS:
            parts = [self._learn(words[i:i + ASKED_WORDS]) for i in range(0, len(words), ASKED_WORDS)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if self.mark is None:
            each = [self._whole(w) for w in words]
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        ids = self._whole(self.mark.join(words))
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(words) - 1:
            raise ValueError("a special token inside a word")
        count = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        return np.delete(ids, marks), count

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's: as the library gives for the whole texts."""
        n, data = len(texts), texts.data
        apart: dict[int, np.ndarray] = {}
        if self.special is not None:
            # Texts with a special token are rare; the library takes them as they are.
            lead = np.flatnonzero(self.first_bytes[data])
            for i in np.unique(np.searchsorted(texts.offsets, lead, "right") - 1).tolist():
                text = data[texts.offsets[i]:texts.offsets[i + 1]].tobytes().decode()
                if self.special.search(text):
                    apart[i] = self._whole(text)
        words = spaced_words(texts) if self.keeps_blanks else plain_words(texts)
        if apart:
            plain = ~np.isin(words.text, list(apart))
            words = Runs(words.start[plain], words.end[plain], words.text[plain])
        each, first, inverse = np.unique(
            run_hashes(data, words), return_index=True, return_inverse=True)
        known, place, count = self.store.find(each)
        new = np.flatnonzero(~known)
        if len(new):
            raw, spans = data.tobytes(), zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())
            ids, found = self._learn([raw[a:b].decode() for a, b in spans])
            place[new], count[new] = self.store.put(ids, found), found
        of_word = count[inverse]
        out = self.store.pool[ranges(place[inverse], of_word)].astype(IDS)
        if len(new):
            self.store.add(each[new], place[new], found)
        size = np.bincount(words.text, of_word, minlength=n).astype(np.int64)
        for i, own in apart.items():
            size[i] = len(own)
        offsets = np.concatenate([[0], np.cumsum(size)])
        if apart:
            filled = np.empty(offsets[-1], dtype=IDS)
            rest = np.ones(offsets[-1], dtype=bool)
            for i, own in apart.items():
                filled[offsets[i]:offsets[i + 1]] = own
                rest[offsets[i]:offsets[i + 1]] = False
            filled[rest] = out
            out = filled
        return out, offsets

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text of a short list."""
        out = []
        for part in texts_of(pa.array(list(texts), pa.string())):
            ids, offsets = self.encode(part)
            out += [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        return out

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._bytes is None:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            chars = {chr(b): b for b in plain}
            rest = [b for b in range(256) if b not in set(plain)]
            chars |= {chr(256 + i): b for i, b in enumerate(rest)}
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            size = max(vocab.values()) + 1
            pieces = [b""] * size
            for token, i in vocab.items():
                pieces[i] = (bytes(map(chars.__getitem__, token)) if all(c in chars for c in token)
                             else token.encode())
            ends = np.cumsum([0, *map(len, pieces)])
            self._bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8), ends
        return self._bytes

    def decode_bytes(self, ids: bytes | np.ndarray) -> bytes:
        """UTF-8 of byte-level ids, special tokens written out."""
        data, ends = self._table()
        ids = np.frombuffer(ids, dtype=IDS) if isinstance(ids, (bytes, bytearray)) else ids
        length = (ends[1:] - ends[:-1])[ids]
        total = np.cumsum(length)
        if not len(ids) or not total[-1]:
            return b""
        at = np.arange(total[-1]) - np.repeat(total - length, length)
        return data[np.repeat(ends[ids], length) + at].tobytes()

    def decode(self, ids: bytes | np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def _cut_of(self, ids: np.ndarray) -> bytes | None:
        raw = self.decode_bytes(ids)
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        return raw

    def join(self, left: bytes, right: bytes, window: int = WINDOW) -> bytes:
        """Ids of the text whose parts have the ids `left` and `right`, cut anywhere.

        Both sides must agree on half a window, which is at least `LEAST_WINDOW` ids: fewer do not tell
        that the words in between are cut as in the whole text.
        """
        window = max(window, LEAST_WINDOW)
        a, b = np.frombuffer(left, dtype=IDS), np.frombuffer(right, dtype=IDS)
        if not len(a) or not len(b):
            return left + right
        margin = window // 2
        while True:
            i, j = max(len(a) - window, 0), min(window, len(b))
            raw = self._cut_of(np.concatenate([a[i:], b[:j]]))
            if raw is not None:
                again = np.frombuffer(self.whole(raw.decode("utf-8")), dtype=IDS)
                starts = i == 0 or np.array_equal(again[:margin], a[i:i + margin])
                stops = j == len(b) or np.array_equal(again[-margin:], b[j - margin:j])
                if starts and stops and (len(again) >= 2 * margin or (i == 0 and j == len(b))):
                    return a[:i].tobytes() + again.tobytes() + b[j:].tobytes()
            if i == 0 and j == len(b):
                return self.whole(raw.decode("utf-8"))
            window *= 2


def halves(text: str, chunk_chars: int, special: re.Pattern | None = None) -> list[tuple[str, bool]]:
    """Parts of at most `chunk_chars`, in order, and whether each begins where the library cuts too.

    That is between two words or before a special token; a special token is never cut.
    """
    if len(text) <= chunk_chars:
        return [(text, False)]
    middle = len(text) // 2
    reach = chunk_chars // 8
    near = _CUT.search(text, max(middle - 1, 0), middle + reach)
    at, between = (near.end() - 1, True) if near else (middle, False)
    for m in special.finditer(text, max(at - 256, 0), at + 256) if special else ():
        if m.start() < at < m.end():
            # A token at the very beginning moves the cut behind it.
            at, between = (m.start() or m.end()), True
    if at == len(text):
        return [(text, False)]
    right = halves(text[at:], chunk_chars, special)
    return halves(text[:at], chunk_chars, special) + [(right[0][0], between)] + right[1:]


def join_tree(encoder: Encoder, parts: list[tuple[bytes, bool]], window: int = WINDOW) -> bytes:
    """Joins neighbours level by level; a part that begins between two words is only appended."""
    while len(parts) > 1:
        level = []
        for k in range(0, len(parts) - 1, 2):
            (left, clean), (right, between) = parts[k], parts[k + 1]
            level.append((left + right if between else encoder.join(left, right, window), clean))
        if len(parts) % 2:
            level.append(parts[-1])
        parts = level
    return parts[0][0]


_KEPT: dict[tuple[str, int], Encoder] = {}


def encoder_for(path: str, stored_words: int = STORED_WORDS) -> Encoder:
    """One encoder for each tokenizer file and worker, so that its words serve all its batches."""
    key = (path, stored_words)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(path, stored_words)
    return _KEPT[key]


def binary_rows(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each text, without a copy for each."""
    ends = pa.py_buffer((offsets * ids.itemsize).astype(np.int64))
    large = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                  [None, ends, pa.py_buffer(np.ascontiguousarray(ids))])
    return large.cast(pa.binary())


def _encoded(df: DataFrame, path: str, stored_words: int, kind: np.dtype = IDS,
             then: tuple | None = None) -> DataFrame:
    """The last column, a text, replaced by its ids."""
    schema = T.StructType(df.schema.fields[:-1] + [T.StructField("ids", T.BinaryType())])

    def rows(batches):
        encoder = encoder_for(path, stored_words)
        for batch in batches:
            for texts in texts_of(batch.column(batch.num_columns - 1)):
                part = batch.slice(texts.first, len(texts))
                ids, offsets = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], binary_rows(ids.astype(kind), offsets)], names=schema.names)
        give_back()

    return _mapped(df, rows, schema, then)


def _mapped(df: DataFrame, rows, schema: T.StructType, then: tuple | None) -> DataFrame:
    """`rows` over the batches of a task, followed by `then` in the same worker."""
    if then is None:
        return df.mapInArrow(rows, schema)
    after, schema = then
    return df.mapInArrow(lambda batches: after(rows(batches)), schema)


def encode_texts(
    df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
    chunk_chars: int = CHUNK_CHARS, window: int = WINDOW, stored_words: int = STORED_WORDS,
    id_bytes: int = 4, then: tuple | None = None,
) -> DataFrame:
    """`keep` columns and `ids` (binary) of each row's whole text. With `id_bytes` 2 the ids are
    16-bit, for vocabularies of at most 65,536. `then`, a function of a task's batches with the
    schema of its result, runs in the same worker; the result is then its own."""
    kind = np.dtype(f"<u{id_bytes}")
    names = [f"k{i}" for i in range(len(keep))]
    own = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                    F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    back = dict(zip(names, keep))
    short = _encoded(own.where(F.length("body") <= chunk_chars), path, stored_words, kind, then)

    longer = own.where(F.length("body") > chunk_chars).select(
        *names, F.monotonically_increasing_id().alias("row"), "body")
    fields = longer.schema.fields[:-1]
    cut = T.StructType(fields + [T.StructField("part", T.IntegerType()),
                                 T.StructField("between", T.BooleanType()),
                                 T.StructField("body", T.StringType())])

    def cut_rows(batches):
        special = encoder_for(path, stored_words).special
        for batch in batches:
            for i in range(batch.num_rows):
                parts = halves(batch.column(batch.num_columns - 1)[i].as_py(), chunk_chars, special)
                row = batch.slice(i, 1)
                n = pa.array(np.zeros(len(parts), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(n) for c in row.columns[:-1]],
                     pa.array(range(len(parts)), pa.int32()), pa.array([b for _, b in parts]),
                     pa.array([t for t, _ in parts], pa.string())], names=cut.names)

    joined = T.StructType(fields[:-1] + [T.StructField("ids", T.BinaryType())])

    def join_rows(batches):
        encoder = encoder_for(path, stored_words)
        key, row, parts = None, None, []

        def made():
            ids = np.frombuffer(join_tree(encoder, parts, window), dtype=IDS).astype(kind).tobytes()
            return pa.RecordBatch.from_arrays(
                [*row.columns[:len(names)], pa.array([ids], pa.binary())], names=joined.names)

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(len(names))[i].as_py()
                if parts and now != key:
                    yield made()
                    parts = []
                key, row = now, batch.slice(i, 1)
                parts.append((batch.column(len(names) + 3)[i].as_py(),
                              batch.column(len(names) + 2)[i].as_py()))
        if parts:
            yield made()

    pieces = _encoded(longer.mapInArrow(cut_rows, cut).repartition("row", "part"), path, stored_words)
    whole = _mapped(pieces.repartition("row").sortWithinPartitions("row", "part"), join_rows, joined, then)
    return short.unionByName(whole).withColumnsRenamed(back if then is None else {})


def decode_ids(
    df: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",),
    to: str = "text",
) -> DataFrame:
    """`keep` columns and the text of each row's `ids` (binary); null ids give an empty text."""
    names = [f"k{i}" for i in range(len(keep))]
    own = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                    F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType(own.schema.fields[:-1] + [T.StructField(to, T.StringType())])

    def rows(batches):
        encoder = encoder_for(path)
        for batch in batches:
            texts = [encoder.decode(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return own.mapInArrow(rows, schema).withColumnsRenamed(dict(zip(names, keep)))
