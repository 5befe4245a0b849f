"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Log-odds of words and word beginnings between toxic and other labelled texts are shrunk by a
Dirichlet prior in proportion to their overall use, and by a use of each term that is dealt to both
sides as all words are: so a term of one side only is told however large the tables are. A text is
scanned once for all of its maximal scoring segments. How large the largest segment of a clean text grows follows an extreme-value law
with the text's length; a segment's expected count under that law tells whether it is significant.
The expected count of a text's best segments, calibrated on the labelled rows, is its score.

Defined results: a null or empty text, or one without letters, has no segments and gets the lowest
score; null labels, or labels of no row, are not used; rows with a null id are scored but never
trained on; without labels of both kinds every score is 0; rows are scored one by one, so repeated
rows and ties get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.quality import held_out
from gaugeline.llm.text import LOWER, Runs, Texts, byte_set, give_back, mixed, run_hashes, runs, texts_of
from gaugeline.session import discard, settle

_LETTER = byte_set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
#: Beginnings of words that are terms of their own, in bytes.
BEGINNINGS = (4, 5, 6)
#: About so many labelled rows are learnt from, chosen by a hash of the id; they are broadcast.
MOST_LABELS = 400_000
#: Terms of the lexicon (16 bytes each) that are sent to all tasks at once.
SENT_TERMS = 1 << 20


def terms(texts: Texts) -> tuple[Runs, list[tuple[np.ndarray, np.ndarray]]]:
    """Words (runs of letters) and, for each kind of term, the words that have one and its hash."""
    data = LOWER[texts.data]
    words = runs(texts, ~_LETTER, data)
    kinds = [(np.arange(len(words.start)), run_hashes(data, words))]
    for k in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > k)
        start = words.start[long]
        cut = Runs(start, start + k, words.text[long])
        with np.errstate(over="ignore"):
            kinds.append((long, mixed(run_hashes(data, cut) + np.uint64(k))))
    return words, kinds


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in time linear in the positive runs.

    Each is a run that no part of outscores and that no longer stretch improves on. A segment that is
    kept knows the nearest one before it that begins on a lower sum, so none is looked at twice; where
    there is none, all segments so far are final.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    breaks = np.flatnonzero(np.diff(positive) > 1)
    starts = positive[np.concatenate([[0], breaks + 1])]
    ends = positive[np.concatenate([breaks, [len(positive) - 1]])] + 1
    final: list[tuple[int, int, float]] = []
    # Start, end, sum before, sum with it, and the place of the nearest one on a lower sum.
    kept: list[tuple[int, int, float, float, int]] = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        before, after = float(sums[start]), float(sums[end])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0:
                final += [(a, b, high - low) for a, b, low, high, _ in kept]
                kept = [(start, end, before, after, -1)]
                break
            if kept[j][3] >= after:
                kept.append((start, end, before, after, j))
                break
            start, _, before, _, lower = kept[j]
            del kept[j:]
            j = lower
    return final + [(a, b, high - low) for a, b, low, high, _ in kept]


@dataclass(frozen=True)
class Lexicon:
    """Hashes of terms in ascending order and their log-odds; `drift` is what each word costs.

    More terms than are sent at once stay in `table` and are looked up block by block.
    """

    hashes: np.ndarray
    odds: np.ndarray
    drift: float
    table: DataFrame | None = None
    blocks: int = 1

    def block(self, number: int) -> Lexicon:
        """The lexicon of the terms of one block."""
        return _lexicon(self.table.where(F.pmod("term", F.lit(self.blocks)) == number), self.drift)

    def best(self, texts: Texts, best: np.ndarray | None = None) -> tuple[Runs, np.ndarray]:
        """The log-odds of the most telling term of each word, or what `best` has already."""
        words, kinds = terms(texts)
        best = np.full(len(words.start), -np.inf) if best is None else best.copy()
        for at, hashes in kinds:
            if len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                hit = self.hashes[place] == hashes
                np.maximum.at(best, at[hit], self.odds[place[hit]])
        return words, best

    def less_drift(self, best: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(best), best, 0.0) - self.drift

    def scores(self, texts: Texts) -> tuple[Runs, np.ndarray]:
        """The log-odds of each word: of its most telling term, less the drift."""
        words, best = self.best(texts)
        return words, self.less_drift(best)


def _lexicon(told: DataFrame, drift: float) -> Lexicon:
    found = told.select("term", "odds").toArrow()
    hashes = found["term"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], found["odds"].to_numpy()[order], drift)


def _labelled(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    # Bounded by `most`, so the texts themselves stay where they are.
    return own.join(F.broadcast(known), "doc_id")


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", prior: float = 500.0, even: float = 1.0, least_z: float = 2.5, drift: float = 2.0,
          most_labels: int = MOST_LABELS, sent_terms: int = SENT_TERMS) -> Lexicon:
    """Log-odds of all telling terms. `prior` is the Dirichlet mass of all terms, `even` that of each
    term, dealt by the sides' words; `drift` is what each word costs."""
    rows = _labelled(df, labels, doc_id, text, label, most_labels).select("label", "body")

    def counted(batches):
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column(1)):
                words, kinds = terms(texts)
                own = toxic[texts.first:texts.first + len(texts)]
                for kind, (at, hashes) in enumerate(kinds):
                    each, place = np.unique(hashes, return_inverse=True)
                    bad = np.bincount(place, own[words.text[at]], minlength=len(each)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(each), kind, dtype=np.int32)), pa.array(each.view(np.int64)),
                        pa.array(bad), pa.array(np.bincount(place, minlength=len(each)) - bad),
                    ], names=["kind", "term", "bad", "good"])

    counts = settle(
        rows.mapInArrow(counted, "kind int, term long, bad long, good long")
        .groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    sums = {r.kind: (r.bad, r.good) for r in
            counts.groupBy("kind").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    nothing = Lexicon(np.zeros(0, dtype=np.uint64), np.zeros(0), drift)
    if not sums or not all(all(s) for s in sums.values()):
        return nothing

    def by_kind(i: int):
        out = F.lit(None).cast("double")
        for kind, s in sums.items():
            out = F.when(F.col("kind") == kind, F.lit(float(s[i]))).otherwise(out)
        return out

    n_bad, n_good = by_kind(0), by_kind(1)
    share = F.lit(prior) * (F.col("bad") + F.col("good")) / (n_bad + n_good)
    # `share` goes to zero with a term's part of all words, `even` does not.
    even_bad, even_good = even * n_bad / (n_bad + n_good), even * n_good / (n_bad + n_good)
    bad, good = F.col("bad") + share + even_bad, F.col("good") + share + even_good
    odds = (F.log(bad / (n_bad + prior + even_bad - bad))
            - F.log(good / (n_good + prior + even_good - good)))
    told = counts.select("term", odds.alias("odds"), (odds / F.sqrt(1 / bad + 1 / good)).alias("z"))
    told = told.where(F.abs("z") >= least_z).select("term", "odds")
    n = told.count()
    if n <= sent_terms:
        return _lexicon(told, drift)
    return Lexicon(nothing.hashes, nothing.odds, drift, settle(told), -(-n // sent_terms))


def _worst(scores: np.ndarray, words: Runs, n: int) -> Iterator[tuple[int, list]]:
    """(text, segments) of the texts that have a positive word."""
    ends = np.searchsorted(words.text, np.arange(n + 1))
    for i in np.unique(words.text[scores > 0]).tolist():
        yield i, segments(scores[ends[i]:ends[i + 1]])


def find_segments(df: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, segments) with the byte spans and scores of all maximal segments."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType())])
    schema = T.StructType([own.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("segments", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    if lexicon.table is not None:
        own = _best_by_blocks(own, lexicon)
    here = lexicon if lexicon.table is None else Lexicon(lexicon.hashes, lexicon.odds, lexicon.drift)

    def rows(batches):
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                if batch.num_columns == 2:
                    words, scores = here.scores(texts)
                else:
                    words, best = here.best(texts, _known(batch, texts))
                    scores = here.less_drift(best)
                n_words = np.bincount(words.text, minlength=len(texts))
                first = np.cumsum(n_words) - n_words
                found: list[list] = [[] for _ in range(len(texts))]
                for i, parts in _worst(scores, words, len(texts)):
                    at = texts.offsets[i]
                    found[i] = [{"start": int(words.start[first[i] + a] - at),
                                 "end": int(words.end[first[i] + b - 1] - at), "score": s}
                                for a, b, s in parts]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, len(texts)), pa.array(n_words),
                    pa.array(found, kind)], names=schema.names)
        give_back()

    return own.mapInArrow(rows, schema)


def _known(batch: pa.RecordBatch, texts: Texts) -> np.ndarray | None:
    """What earlier blocks of terms found for the words of some texts, which follow one another."""
    parts = batch.column(2).slice(texts.first, len(texts))
    if parts.null_count:
        return None
    return np.frombuffer(b"".join(x.as_py() for x in parts), dtype=np.float64)


def _best_by_blocks(own: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, body, best): the most telling term of each word, over all blocks of the lexicon.

    Texts are written once for each block with what was found so far, and the copy before is deleted.
    """
    names, old = ["doc_id", "body", "best"], None
    schema = T.StructType([*own.schema.fields, T.StructField("best", T.BinaryType())])
    rows = own.withColumn("best", F.lit(None).cast("binary"))
    for number in range(lexicon.blocks):
        here = lexicon.block(number)

        def looked_up(batches, here=here):
            for batch in batches:
                for texts in texts_of(batch.column(1)):
                    words, best = here.best(texts, _known(batch, texts))
                    ends = np.searchsorted(words.text, np.arange(len(texts) + 1))
                    found = [best[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(texts.first, len(texts)), batch.column(1).slice(texts.first, len(texts)),
                        pa.array(found, pa.binary())], names=names)

        rows = settle(rows.mapInArrow(looked_up, schema))
        if old is not None:
            discard(old)
        old = rows
    return rows


#: Texts have their evidence counted on a grid of this step, up to this many cells.
_STEP, _CELLS = 0.25, 2000


@dataclass(frozen=True)
class Law:
    """Chance segments: expected count `scale * words * exp(-rate * score)`; then the calibration."""

    scale: float
    rate: float
    slope: float
    shift: float
    empty: float


def _evidence(found: DataFrame, scale: float, rate: float) -> DataFrame:
    """`evidence`: minus the logarithm of the expected counts, summed over significant segments."""
    chance = lambda s: F.lit(np.log(scale)) + F.log(F.col("n_words")) - rate * s["score"]
    logs = F.transform("segments", lambda s: -chance(s))
    best = F.array_max(logs)
    rest = F.aggregate(F.filter(logs, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    return found.withColumn("evidence", F.greatest(best, rest))


def fit_law(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> Law | None:
    """The extreme-value law of the clean training rows, and a logistic curve over all of them."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    top = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    rows = settle(found.join(known, "doc_id").select("label", "n_words", "segments", top.alias("top")))
    clean = rows.where((F.col("label") == 0) & (F.col("n_words") > 0))
    figures = clean.agg(F.count(F.lit(1)).alias("n"), F.avg("top").alias("m"),
                        F.stddev_pop("top").alias("s")).first()
    if not figures.n or rows.where("label = 1").isEmpty():
        return None
    # The spread of a Gumbel law is pi / (rate * sqrt 6); the scale then has a closed best value.
    rate = float(np.clip(np.pi / (np.sqrt(6) * max(figures.s, 1e-9)), 0.2, 2.0))
    mass = clean.agg(F.avg(F.col("n_words") * F.exp(-rate * F.col("top")))).first()[0]
    scale = 1.0 / max(mass, 1e-300)
    cell = F.coalesce(F.least(F.greatest(F.round((F.col("evidence") + 50) / _STEP), F.lit(0.0)),
                              F.lit(float(_CELLS))), F.lit(-1.0))
    grid = (_evidence(rows, scale, rate).groupBy(cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).collect())
    none = [r for r in grid if r.cell < 0]
    empty = (sum(r.bad for r in none) + 0.5) / (sum(r.n for r in none) + 10.0)
    grid = [r for r in grid if r.cell >= 0]
    x = np.array([r.cell * _STEP - 50 for r in grid], float)
    n, bad = np.array([r.n for r in grid], float), np.array([r.bad for r in grid], float)
    theta = np.array([0.0, 0.0])
    if len(x):
        design = np.column_stack([x, np.ones(len(x))])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            slope = design.T @ (bad - n * p) - 0.01 * theta
            curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            theta = theta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
    return Law(scale, rate, float(max(theta[0], 0.0)), float(theta[1]), float(min(empty, 0.49)))


def score(found: DataFrame, law: Law | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, passages): the significant passages are those expected by chance
    less than once in a hundred such texts."""
    if law is None:
        return found.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                            F.filter("segments", lambda s: F.lit(False)).alias("passages"))
    told = _evidence(found, law.scale, law.rate)
    value = F.coalesce(1 / (1 + F.exp(-(law.slope * F.col("evidence") + law.shift))), F.lit(law.empty))
    least = (F.lit(np.log(law.scale)) + F.log(F.col("n_words")) - np.log(0.01)) / law.rate
    return told.select("doc_id", value.alias("score"), (value >= threshold).cast("int").alias("predicted"),
                       F.filter("segments", lambda s: s["score"] >= least).alias("passages"))
