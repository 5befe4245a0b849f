"""Near-duplicate texts: one-permutation MinHash, densified, in banded buckets with star candidates.

One hash of each word shingle gives both its bin and its value; a text's sketch is the least value
of every bin, and empty bins borrow from full ones in an order that is the same for all texts.
Bands of the sketch are bucket keys. A bucket offers only a star of candidates, one centre with each
other member; the centre is another one in each bucket. Candidates are confirmed on whole sets.
Buckets that still hold several components are looked through for pairs between components that
their sketches do not rule out; these are compared on whole sets inside the bucket, which gives no
more links than members. So a link that a star has passed over is found.

Equal sets are one node. Defined results: a null or empty text, or one of blanks, has no shingles
and is its own component; a text with fewer words than a shingle has one shingle; rows with a null
id are compared like others, a component's id is its smallest id that is not null (null if there is
none) and a row is kept if its id is the component's, or both are null; rows with equal ids are all
kept if one is; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.components import components, with_least_id
from gaugeline.llm.text import (
    _PLACE, BLANKS, LOWER, Texts, give_back, mixed, numbers, run_hashes, runs, shingle_hashes, texts_of,
)
from gaugeline.session import settle

#: Bins of a sketch.
BINS = 256
#: How often a pair that is just similar enough may share no bucket.
MISS = 1e-5
#: Members of a bucket compared at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 512
#: Ids of candidates up to this many are broadcast (8 bytes each) to pick their sets from the files.
MOST_IDS_SENT = 1_000_000
_SIZE = 6  # bytes kept of a shingle's hash


def band_rows(percent: int, miss: float = MISS) -> int:
    """The widest bands, in bins, at which a pair at `percent` shares no bucket at most `miss` times."""
    def missed(rows: int) -> float:
        return (1 - (percent / 100) ** rows) ** (BINS // rows)

    return max((r for r in range(1, 17) if missed(r) <= miss), default=1)


def _borrowed(sketch: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Every empty bin takes the value of the first full bin on a path that only the bin decides."""
    out = sketch.copy()
    text, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(text):
        attempt += 1
        source = (numbers(BINS, 100 + attempt) % np.uint64(BINS)).astype(np.int64)[bin_]
        hit = full[text, source]
        out[text[hit], bin_[hit]] = sketch[text[hit], source[hit]]
        text, bin_ = text[~hit], bin_[~hit]
    return out


def sketches(texts: Texts, size: int, rows: int) -> dict[str, np.ndarray]:
    """Sets, sketches and band keys of the texts of a slice."""
    n = len(texts)
    data = LOWER[texts.data]
    words = runs(texts, BLANKS, data)
    hashes, owner = shingle_hashes(run_hashes(data, words), words.text, n, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[fresh], owner[fresh]
    bin_ = (hashes >> np.uint64(56)).astype(np.int64)
    place = owner * BINS + bin_
    least = np.concatenate([[True], place[1:] != place[:-1]])[:len(place)]
    sketch = np.zeros((n, BINS), dtype=np.uint64)
    full = np.zeros((n, BINS), dtype=bool)
    sketch[owner[least], bin_[least]] = hashes[least]
    full[owner[least], bin_[least]] = True
    small = np.where(full, sketch % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)
    bands = BINS // rows
    dense = _borrowed(sketch, full)[:, :bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        keys = mixed((dense * _PLACE[:rows]).sum(axis=2, dtype=np.uint64)
                     + numbers(bands, 3))
        count = np.bincount(owner, minlength=n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes), dtype=np.uint64)])
        ends = np.concatenate([[0], np.cumsum(count)])
        one = total[ends[1:]] - total[ends[:-1]]
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(7)), dtype=np.uint64)])
        two = total[ends[1:]] - total[ends[:-1]]
    packed = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :_SIZE]
    return {"n": count, "one": one, "two": two, "keys": keys, "small": small,
            "set": np.ascontiguousarray(packed), "ends": ends}


_SKETCHED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType()),
    T.StructField("keys", T.ArrayType(T.LongType(), False)), T.StructField("small", T.BinaryType()),
    T.StructField("shingles", T.BinaryType()),
])


def sketch_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5,
                 rows_of_band: int = 8) -> DataFrame:
    """(doc_id, n, one, two, keys, small, shingles) of each row; `one` and `two` identify the set."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType([own.schema["doc_id"], *_SKETCHED.fields])

    def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(
            pa.binary(), len(ends) - 1,
            [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    def rows(batches):
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                s, n = sketches(texts, size, rows_of_band), len(texts)
                bands = s["keys"].shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, n), pa.array(s["n"]),
                    pa.array(s["one"].view(np.int64)), pa.array(s["two"].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands),
                                             pa.array(s["keys"].view(np.int64).ravel())),
                    binary(s["small"], np.arange(n + 1) * 2 * BINS),
                    binary(s["set"], s["ends"] * _SIZE),
                ], names=schema.names)
        give_back()

    return own.mapInArrow(rows, schema)


def _similar(n: str, m: str, percent: int):
    """Whether sets of these sizes can reach the similarity at all."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def picked(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets of these rows; few enough rows are broadcast, so the other sets stay in their files."""
    rows = settle(rows)
    return sets.join(F.broadcast(rows) if rows.count() <= MOST_IDS_SENT else rows, "row")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar. `sets`: (row, shingles)."""
    sets = settle(picked(sets, pairs.select(F.col("a").alias("row")).union(
        pairs.select(F.col("b").alias("row"))).distinct()))
    both = (
        pairs.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b")), "b")
        .join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a")), "a")
        .select("a", "b", "of_a", "of_b")
    )

    def rows(batches):
        for batch in batches:
            keep = [_similar_sets(_of(x.as_py()), _of(y.as_py()), percent)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
            give_back()

    return both.mapInArrow(rows, "a long, b long")


def _of(packed: bytes) -> np.ndarray:
    """The shingle hashes of a set."""
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _SIZE)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :_SIZE] = raw
    return wide.view(np.uint64).ravel()


def _similar_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _open_pairs(group: pa.Table, percent: int):
    """Pairs (i, j) of a bucket's rows in different components that their sketches do not rule out.

    `own` is a member's block; the group compares block `low` with block `high`. A pair that shares
    an earlier band is left to that band's bucket.
    """
    least = percent / 100
    own, n, component = (group.column(c).to_numpy() for c in ("own", "n", "component"))
    small = np.frombuffer(b"".join(group.column("small").to_pylist()), dtype=np.uint16).reshape(-1, BINS)
    keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
    low, high, key = (group.column(c)[0].as_py() for c in ("low", "high", "key"))
    earlier = int(np.flatnonzero(keys[0] == key)[0])
    left = np.flatnonzero(own == low)
    right = left if low == high else np.flatnonzero(own == high)
    for at in range(0, len(left), 64):
        part = left[at:at + 64]
        allowed = (component[part][:, None] != component[right][None, :]) & (
            100 * np.minimum(n[part][:, None], n[right][None, :])
            >= percent * np.maximum(n[part][:, None], n[right][None, :]))
        if low == high:
            allowed &= part[:, None] < right[None, :]
        i, j = np.nonzero(allowed)
        for to in range(0, len(i), 1 << 13):
            a, b = part[i[to:to + (1 << 13)]], right[j[to:to + (1 << 13)]]
            x, y = small[a], small[b]
            seen = ((x > 0) | (y > 0)).sum(axis=1)
            equal = ((x == y) & (x > 0)).sum(axis=1)
            # The bins show `seen` of about `union` shingles, drawn without putting back.
            union = np.maximum(n[a], n[b])
            spread = np.sqrt(least * (1 - least) / seen * np.maximum(1 - seen / (union + 1), 0.05))
            near = equal / seen >= least - 4.5 * spread - 2 / seen
            near &= ~(keys[a, :earlier] == keys[b, :earlier]).any(axis=1)
            yield a[near], b[near], (equal / seen)[near]


def _open_members(members: DataFrame, percent: int) -> DataFrame:
    """The members of a bucket that have such a pair: at most all of them."""

    def group(batch: pa.Table) -> pa.Table:
        has = np.zeros(batch.num_rows, dtype=bool)
        for a, b, _ in _open_pairs(batch, percent):
            has[a] = has[b] = True
        give_back()
        return batch.select(["key", "low", "high", "own", "row"]).filter(pa.array(has))

    return members.groupBy("key", "low", "high").applyInArrow(
        group, "key long, low int, high int, own int, row long")


def _found_links(members: DataFrame, percent: int) -> DataFrame:
    """Links of whole sets that join components within a bucket: fewer than it has members."""

    def group(batch: pa.Table) -> pa.Table:
        row, up = batch.column("row").to_pylist(), {c: c for c in batch.column("component").to_pylist()}
        component, links = batch.column("component").to_pylist(), []
        sets = [_of(x) for x in batch.column("shingles").to_pylist()]

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for a, b, estimate in _open_pairs(batch, percent):
            order = np.argsort(-estimate, kind="stable")
            for i, j in zip(a[order].tolist(), b[order].tolist()):
                x, y = root(component[i]), root(component[j])
                if x != y and _similar_sets(sets[i], sets[j], percent):
                    up[max(x, y)] = min(x, y)
                    links.append((min(row[i], row[j]), max(row[i], row[j])))
        give_back()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([y for _, y in links], pa.int64())})

    return members.groupBy("key", "low", "high").applyInArrow(group, "a long, b long")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80,
             size: int = 5) -> DataFrame:
    """The rows of `df` whose document is the smallest of its component, with their columns as they
    are. Rows with equal ids are one document and stay or go together; so are those with null ids
    that are linked only among themselves."""
    found = settle(near_duplicates(df, doc_id, text, percent, size))
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept"))
    gone = settle(gone.select(F.col("doc_id").alias("gone_id")))
    if gone.count() <= MOST_IDS_SENT:
        gone = F.broadcast(gone)
    own = df.toDF(*[f"k{i}" for i in range(len(df.columns))])
    key = F.col(f"k{df.columns.index(doc_id)}")
    return own.join(gone, key.eqNullSafe(F.col("gone_id")), "left_anti").toDF(*df.columns)


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, size: int = 5,
    block: int = BLOCK, miss: float = MISS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): texts whose shingle sets are linked, directly or by
    a chain, at a Jaccard similarity of `percent` or more are one component.

    Every link is confirmed on whole sets. Candidates come from buckets: a pair at exactly `percent`
    shares none at most `miss` times, a more similar pair far less often, and the bands are made as
    narrow as that takes (7 bins at 85 percent, 6 at 80, 4 at 70, 2 at 50). Inside a bucket, a pair in
    different components is passed over if its sketches are 4.5 standard deviations too far apart,
    some 3 times in a million at exactly `percent`. A pair that is missed still ends up in one
    component if any chain of other links joins it.
    """
    sketched = sketch_table(df, doc_id, text, size, band_rows(percent, miss))
    table = settle(sketched.withColumn("row", F.monotonically_increasing_id()))
    filled = table.where("n > 0")
    first = filled.groupBy("one", "two", "n").agg(F.min("row").alias("node"))
    first = settle(first)
    nodes = settle(
        table.select("row", "n", "keys", "small").join(first.select(F.col("node").alias("row")), "row"))

    member = nodes.select(F.explode("keys").alias("key"), "row", "n")
    stars = (
        member.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"),
             F.min_by("row", F.xxhash64("row", "key")).alias("a"),
             F.min_by("n", F.xxhash64("row", "key")).alias("m"))
        .where("members > 1").drop("members")
    )
    pairs = settle(
        member.join(stars, "key").where("row <> a").where(_similar("n", "m", percent))
        .select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b")).distinct()
    )
    sets = table.select("row", "shingles")
    links = settle(confirmed(pairs, sets, percent))
    by_node = settle(components(links))

    labelled = settle(
        member.join(stars.select("key"), "key")
        .join(by_node.select(F.col("node").alias("row"), "component"), "row", "left")
        .select("key", "row", "n", F.coalesce("component", "row").alias("component"))
    )
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
        .where("x <> y").select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = (
        labelled.join(open_keys, "key").select("*", own.alias("own"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                "own", "row", "n", "component")
    )
    sketch = nodes.select("row", "keys", "small")
    near = settle(_open_members(dealt.join(sketch, "row"), percent))
    if not near.isEmpty():
        more = (
            near.join(sketch, "row").join(picked(sets, near.select("row").distinct()), "row")
            .join(by_node.select(F.col("node").alias("row"), "component"), "row", "left")
            .withColumn("component", F.coalesce("component", "row"))
            .join(nodes.select("row", "n"), "row")
        )
        by_node = settle(components(links.union(_found_links(more, percent))))

    ids = (
        filled.select("row", "doc_id", "n", "one", "two").join(first, ["one", "two", "n"])
        .join(by_node.select("node", "component"), "node", "left")
        .select("row", "doc_id", "n", F.coalesce("component", "node").alias("component"))
    )
    linked = with_least_id(settle(ids.select("doc_id", "n", "component")), "doc_id")
    alone = table.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
