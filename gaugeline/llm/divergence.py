"""How far the words of each source lie from those of the other sources of its language.

Tasks count terms with Arrow's own kernels: texts in lower case (`ascii_lower`), cut by an expression
(`split_pattern_regex`), terms as codes (`dictionary_encode`), and counts by row, then by language,
source and term (hash `group_by`). The partial counts are summed, and the terms of a language are
dealt to shards, each a matrix of terms by sources, in which shares and divergences are whole numbers.

Defined results: a null text, language or source counts as the empty text; a row is a document, rows
with equal ids too; a language with one source has no pairs; a group without kept terms still takes
part in the pairs; equal values are ranked by the item's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.text import SLICE_BYTES, give_back
from gaugeline.session import settle

#: What lies between terms: ASCII that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 10 ** 9
#: Counted rows a task holds before it adds them up, and passes them on if that leaves half of them.
HELD_ROWS = 1 << 19
#: Cells of the matrix of one shard.
CELLS = 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])


def _slices(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `slice_bytes` of text; a longer single text is a slice of its own."""
    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        to = min(max(int(np.searchsorted(upto, before + slice_bytes, "right")), at + 1), batch.num_rows)
        # A copy, not a view: `ascii_lower` of a view of a large_string column gives wrong bytes.
        yield batch.take(pa.array(np.arange(at, to)))
        at = to


def _counted(part: pa.RecordBatch) -> list[pa.Table]:
    """Terms of a slice by language and source, and one row without a term for each such group."""
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    groups = pa.table({"lang": part.column("lang"), "source": part.column("source")}).group_by(
        ["lang", "source"], use_threads=False).aggregate([])
    n = groups.num_rows
    marks = pa.table([groups["lang"], groups["source"], pa.nulls(n, pa.string()),
                      pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64))], schema=_COUNTS)
    lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text").cast(pa.large_string())), BETWEEN)
    term, row = lists.flatten(), pc.list_parent_indices(lists)
    whole = pc.greater(pc.binary_length(term), 0)
    term, row = term.filter(whole).dictionary_encode(), row.filter(whole)
    by_row = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate(
        [([], "count_all")])
    by_group = pa.table({
        "lang": lang.indices.take(by_row["row"]), "source": source.indices.take(by_row["row"]),
        "term": by_row["term"], "n": by_row["count_all"],
    }).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    return [marks, pa.table([
        lang.dictionary.take(by_group["lang"]), source.dictionary.take(by_group["source"]),
        term.dictionary.take(by_group["term"]).cast(pa.string()), by_group["n_sum"],
        by_group["n_count"].cast(pa.int64())], schema=_COUNTS)]


def _added(parts: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate(
        [("n", "sum"), ("docs", "sum")])
    return added.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def term_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    held_rows: int = HELD_ROWS, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(lang, source, term, n, docs): uses of each term and rows that hold it; a null term marks a group."""
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                       for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in _slices(batch, slice_bytes):
                held += _counted(part)
                if sum(t.num_rows for t in held) > held_rows:
                    held = [_added(held)]
                    if held[0].num_rows > held_rows // 2:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held = []
                    give_back()
        if held:
            yield from _added(held).to_batches(max_chunksize=1 << 16)

    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), by long division, three digits a step.

    Exact for `count + 1 <= whole < 9 * 10^15`, where the product itself may not fit.
    """
    rest = count + 1
    out = np.zeros(np.broadcast(rest, whole).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _shard(counts: pa.Table, sides: pa.Table, top: int) -> pa.Table:
    """What the terms of one shard add to the pairs, and the best of them for each source."""
    lang = sides["lang"][0].as_py()
    names = sides["source"].to_pylist()
    # In the order of the bytes, which is that of the code points.
    order = sorted(range(len(names)), key=names.__getitem__)
    names = [names[i] for i in order]
    whole = sides["whole"].to_numpy()[order]
    whole_lang = sides["whole_lang"][0].as_py()
    term = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else None
    terms = term.dictionary.to_pylist() if term is not None else []
    cells = np.zeros((len(terms), len(names)), dtype=np.int64)
    if len(terms):
        place = pc.index_in(counts["source"].combine_chunks(), pa.array(names, pa.string())).to_numpy()
        cells[term.indices.to_numpy(), place] = counts["n"].to_numpy()
    p = shares(cells, whole[None, :])
    q = shares(cells.sum(axis=1), np.int64(whole_lang))
    by_name = np.empty(len(terms), dtype=np.int64)
    by_name[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    source, part, item, value = [], [], [], []
    for s, name in enumerate(names):
        gap = p[:, s:s + 1] - p
        sums = (gap * gap // p).sum(axis=0)
        others = [t for t in range(len(names)) if t != s]
        source += [name] * len(others)
        part += ["pair"] * len(others)
        item += [names[t] for t in others]
        value += sums[others].tolist()
        own = np.flatnonzero((cells[:, s] > 0) & (p[:, s] > q))
        f = (p[own, s] - q[own]) ** 2 // q[own]
        best = np.lexsort((by_name[own], -f))[:top]
        source += [name] * len(best)
        part += ["term"] * len(best)
        item += [terms[i] for i in own[best]]
        value += f[best].tolist()
    return pa.table([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()),
                     pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())],
                    names=["lang", "source", "part", "item", "value"])


def source_divergence(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = 3, top: int = 200, cells: int = CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from other sources and telling terms.

    A language keeps the terms of at least `least_docs` documents. Part `pair` sums, over all kept
    terms, (p - q)^2 / q for each other source; part `term` has the `top` terms that a source uses
    more than its language. Counts are shuffled by (language, term) after two partial sums, so a
    source with most of the rows is spread; a shard holds at most about `cells` cells.
    """
    counts = settle(term_counts(df, text, lang, source))
    of_term = Window.partitionBy("lang", "term")
    kept = settle(
        counts.where("term IS NOT NULL")
        .withColumns({"all_docs": F.sum("docs").over(of_term), "one": F.col("source") == F.min("source").over(of_term)})
        .where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "one"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("one").cast("long")).alias("own"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = settle(groups.fillna(0, ["total", "own"]))
    langs = settle(groups.groupBy("lang").agg(
        F.sum("own").alias("terms"), F.sum("total").alias("total_lang"), F.count(F.lit(1)).alias("sources"),
    ).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / cells)).cast("int")))
    sides = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source",
        (F.col("total") + F.col("terms")).alias("whole"), (F.col("total_lang") + F.col("terms")).alias("whole_lang"))
    dealt = kept.join(langs.select("lang", "shards"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return _shard(left, right, top)

    found = settle(
        dealt.groupBy("lang", "shard").cogroup(sides.groupBy("lang", "shard"))
        .applyInArrow(work, "lang string, source string, part string, item string, value long"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = (found.where("part = 'pair'").groupBy("lang", "source", "part", "item")
             .agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order)))
    telling = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(telling)
