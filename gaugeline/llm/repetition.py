"""Quality rules on repetition: suffix arrays over the words of a text.

The suffixes of all texts of a slice are sorted by prefix doubling; only suffixes that are not yet
told apart are sorted again. The longest common prefix of neighbours in that order, found on sums
that tell stretches of words apart, gives, for each position, the longest passage that starts there and occurs again in the same text. These passages
are the longest-common-prefix intervals seen from their members; the union of their spans is the
repeated part of the text. A text is kept if its repeated part and its longest repeat are in limits.

Defined results: a null or empty text, or one of blanks only, has no words, zeros and
`base_failed`; rows are judged one by one, so repeated rows, ties and null ids give a row each;
other columns are passed through when `keep` names them; an empty table gives an empty table.
Memory follows the slice (about a megabyte of text) or the longest single text, never the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.text import BLANKS, Texts, byte_set, give_back, mixed, run_hashes, runs, texts_of

SYMBOLS = byte_set(b"#*$%&|<>")
_NEWLINE = byte_set(b"\n")

FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()), ("n_spans", T.LongType()), ("longest_repeat", T.LongType()),
    ("covered_words", T.LongType()), ("covered_fraction", T.DoubleType()),
)


def suffix_ranks(symbols: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, by their first 1, 2, 4, ... symbols until all differ.

    `stop[i]` is where the text of position i ends. `symbols` of different texts must differ.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = head
    sizes = np.bincount(head, minlength=n)
    active, step = order[sizes[head] > 1], 1
    while len(active):
        after = active + step
        inside = after < stop[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        own = rank[active].astype(np.int64)
        key = own * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key, own = active[by], key[by], own[by]
        index = np.arange(len(active))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = np.concatenate([[True], own[1:] != own[:-1]])
        head = np.maximum.accumulate(np.where(new, index, 0))
        rank[active] = own + head - np.maximum.accumulate(np.where(old, index, 0))
        sizes = np.bincount(head, minlength=len(active))
        active = active[sizes[head] > 1]
        step *= 2
    return rank


#: Pairs of suffixes looked at at once.
_PAIRS = 1 << 18
#: Primes below 2^31, whose products fit in 64 bits, and a base for each.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1481765933))


class Stretches:
    """Sums of symbols times powers, by two primes: a stretch is told by differences of two numbers."""

    def __init__(self, symbols: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in _PRIMES:
            power = np.ones(len(symbols) + 1, dtype=np.int64)
            done, factor = 1, base
            while done < len(power):
                power[done:2 * done] = power[:min(done, len(power) - done)] * factor % prime
                done, factor = 2 * done, factor * factor % prime
            total = np.zeros(len(symbols) + 1, dtype=np.int64)
            # Below 2^31 each, so that four billion of them add up in 63 bits.
            np.cumsum((symbols % np.uint64(prime)).astype(np.int64) * power[:-1] % prime, out=total[1:])
            self.sums.append(total)
            self.powers.append(power)

    def same(self, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Whether the `n` symbols from i on, which is before j, are those from j on."""
        out = np.ones(len(i), dtype=bool)
        for (prime, _), total, power in zip(_PRIMES, self.sums, self.powers):
            out &= ((total[i + n] - total[i]) % prime * power[j - i] % prime == (total[j + n] - total[j]) % prime)
        return out


def common_prefixes(symbols: np.ndarray, stop: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at `left` and `right` share: doubled until they differ, then halved.

    Memory is a few numbers for each symbol, however long the passages are.
    """
    stretches = Stretches(symbols)
    out = np.zeros(len(left), dtype=np.int64)
    for at in range(0, len(left), _PAIRS):
        i = np.minimum(left[at:at + _PAIRS], right[at:at + _PAIRS])
        j = np.maximum(left[at:at + _PAIRS], right[at:at + _PAIRS])
        most = np.minimum(stop[i] - i, stop[j] - j)
        common, fails = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)

        def longer(pairs: np.ndarray, step: int) -> np.ndarray:
            """Of some pairs those that share `step` symbols more."""
            pairs = pairs[common[pairs] + step <= most[pairs]]
            return pairs[stretches.same(i[pairs] + common[pairs], j[pairs] + common[pairs], step)]

        going, step = np.arange(len(i)), 1
        while len(going):
            passed = longer(going, step)
            common[passed] += step
            fails[np.setdiff1d(going, passed, assume_unique=True)] = step
            going, step = passed, 2 * step
        while step > 1:
            step //= 2
            passed = longer(np.flatnonzero(fails > step), step)
            common[passed] += step
        out[at:at + _PAIRS] = common
    return out


def repeat_lengths(symbols: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest passage from there that occurs again."""
    n = len(symbols)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[suffix_ranks(symbols, stop)] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    common = common_prefixes(symbols, stop, left, right)
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a passage of at least `least` symbols that occurs again."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _judge(texts: Texts, window: int, passage: int, least_words: int, base_percent: int,
           max_fraction: float, max_longest: int) -> list[np.ndarray]:
    n = len(texts)
    words = runs(texts, BLANKS)
    n_words = np.bincount(words.text, minlength=n)
    in_word = ~BLANKS[texts.data]
    word_chars = texts.count(in_word & ((texts.data & 0xC0) != 0x80))
    n_symbols = texts.count(SYMBOLS[texts.data])

    lines = runs(texts, _NEWLINE)
    with np.errstate(over="ignore"):
        line = mixed(run_hashes(texts.data, lines) + lines.text.astype(np.uint64))
        symbols = mixed(run_hashes(texts.data, words) + words.text.astype(np.uint64))
    has_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line, owner = line[has_word], lines.text[has_word]
    _, first = np.unique(line, return_index=True)
    n_dup_lines = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)

    stop = np.cumsum(n_words)[words.text]
    longest = repeat_lengths(symbols, stop)
    inside = covered(longest, window)
    n_repeat_words = np.bincount(words.text[inside], minlength=n)
    inside = covered(longest, passage)
    n_covered = np.bincount(words.text[inside], minlength=n)
    new_text = np.concatenate([[True], words.text[1:] != words.text[:-1]])[:len(inside)]
    opens = inside & (new_text | ~np.concatenate([[False], inside[:-1]])[:len(inside)])
    n_spans = np.bincount(words.text[opens], minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, words.text, longest)

    base_failed = (n_words < least_words) | (100 * n_repeat_words > base_percent * n_words)
    fraction = n_covered / np.maximum(n_words, 1)
    kept = ~base_failed & (fraction <= max_fraction) & (top <= max_longest)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
            n_spans, top, n_covered, fraction]


def repetition_rules(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), window: int = 5,
    passage: int = 10, least_words: int = 10, base_percent: int = 20, max_fraction: float = 0.15,
    max_longest: int = 100,
) -> DataFrame:
    """`keep` columns and the repetition figures of each row's whole text, with `kept`.

    The base rule wants `least_words` words and at most `base_percent` of them in windows of
    `window` words that occur again. Kept are texts that pass it, with at most `max_fraction` of
    the words in repeated passages of `passage` words or more and none longer than `max_longest`.
    """
    names = [f"k{i}" for i in range(len(keep))]
    own = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                    F.col(f"`{text}`").cast("string").alias("body"))
    limits = (window, passage, least_words, base_percent, max_fraction, max_longest)
    return _judged(own, limits).withColumnsRenamed(dict(zip(names, keep)))


def keep_passing(df: DataFrame, text: str = "text", window: int = 5, passage: int = 10,
                 least_words: int = 10, base_percent: int = 20, max_fraction: float = 0.15,
                 max_longest: int = 100) -> DataFrame:
    """The rows of `df` that `repetition_rules` keeps, with their columns as they are."""
    own = df.toDF(*[f"k{i}" for i in range(len(df.columns))])
    own = own.select("*", F.col(f"k{df.columns.index(text)}").cast("string").alias("body"))
    limits = (window, passage, least_words, base_percent, max_fraction, max_longest)
    return _judged(own, limits).where("kept").select(*own.columns[:-1]).toDF(*df.columns)


def _judged(own: DataFrame, limits: tuple) -> DataFrame:
    """The columns of `own` but the last, the text, and the figures of the text."""
    schema = T.StructType(own.schema.fields[:-1] + [T.StructField(n, t) for n, t in FIELDS])

    def rows(batches):
        for batch in batches:
            for texts in texts_of(batch.column(batch.num_columns - 1)):
                part = batch.slice(texts.first, len(texts))
                made = [pa.array(x, pa.bool_() if x.dtype == bool else
                                 pa.float64() if x.dtype.kind == "f" else pa.int64())
                        for x in _judge(texts, *limits)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *made], names=[f.name for f in schema.fields])
        give_back()

    return own.mapInArrow(rows, schema)
