"""Exact medians without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.time import ref
from gaugeline.session import settle

BINS_PER_OCTAVE = 2_048
_TOP = 1_200 * BINS_PER_OCTAVE


def _bin(value: Column) -> Column:
    octave = F.least(F.log2(F.abs(value)), F.lit(1_100.0))
    depth = F.floor(octave * BINS_PER_OCTAVE).cast("bigint") + F.lit(_TOP)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.signum(value).cast("bigint") * depth)


#: Rows of a middle bin, more of which are binned again, and the bins one is cut into.
BIN_ROWS, PIECES = 100_000, 4_096


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _holding(counts: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """The bins that hold a middle rank: `counts` has n, lo, hi by group and bin, and what is known
    of the group, `below` (rows before its bins) and `all`."""
    over = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("below") + F.sum("n").over(over)
    low, high = _div(F.col("all") - 1, 2), _div(F.col("all"), 2)

    def holds(rank: Column) -> Column:
        return (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))

    found = counts.withColumn("upto", upto).where(holds(low) | holds(high))
    return found.withColumn("below", F.col("upto") - F.col("n"))


def middle_bins(long: DataFrame, names: Sequence[str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """For each group and column the bins [lo, hi] that hold the middle ranks, with n, below and all.

    `long` has `__which`, `__value` and the keys. The first pass takes bins of one part in 2,048 of a
    power of two. As long as a middle bin of more than one value has over `bin_rows` rows, it is cut
    again, between the least and the greatest value in it, so each pass leaves fewer.
    """
    group, value = [*names, "__which"], F.col("__value")
    measures = [F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")]
    first = long.groupBy(*group, _bin(value).alias("bin")).agg(*measures)
    whole = F.sum("n").over(Window.partitionBy(*group))
    bins = settle(_holding(first.withColumns({"all": whole, "below": F.lit(0).cast("bigint")}), group, "bin")
                  .select(*group, "lo", "hi", "n", "below", "all"))
    while (bins.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("n")))).first()[0] or 0) > bin_rows:
        inside = _inside(long, bins, names)
        # Rounding keeps the order, so equal pieces are neighbours in value.
        piece = F.when(F.col("lo") < F.col("hi"), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * PIECES))
        known = [*group, "below", "all", F.col("lo").alias("of")]
        counts = inside.groupBy(*known, F.coalesce(piece, F.lit(0)).alias("bin")).agg(*measures)
        bins = settle(_holding(counts, [*group, "of"], "bin").select(*group, "lo", "hi", "n", "below", "all"))
    return bins


def _inside(long: DataFrame, bins: DataFrame, names: Sequence[str]) -> DataFrame:
    """The values that lie in a middle bin of their group, with what is known of the bin."""
    own = bins.select(*[F.col(n).alias(f"{n}m") for n in [*names, "__which"]], "lo", "hi", "below", "all")
    match = (F.col("__which") == F.col("__whichm")) & F.col("__value").between(F.col("lo"), F.col("hi"))
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}m"))
    return long.join(own, match)


def exact_medians(
    df: DataFrame, columns: Mapping[str, str], *, keys: Sequence[str] = (), bin_rows: int = BIN_ROWS
) -> DataFrame:
    """One row for each key with the exact median of each column (`columns` maps input to output).

    Missing values are skipped and an even count averages the middle two, so a column without
    values gives a missing median. Values are counted by narrow bins on the map side, and the bins
    that hold the middle are cut further until they are small (see `middle_bins`); only the distinct
    values of these move. The columns are written once, so all passes read them alone.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    narrow = settle(df.select(
        *[ref(k).alias(n) for k, n in zip(keys, names)],
        *[ref(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)],
    ))
    cells = F.array(*[
        F.struct(F.lit(i).alias("__which"), F.col(f"__v{i}").alias("__value"))
        for i in range(len(columns))
    ])
    value = F.col("__value")
    long = (
        narrow.select(*names, F.explode(cells).alias("__cell")).select(*names, "__cell.*")
        .where(value.isNotNull() & ~F.isnan(value))
    )
    group = [*names, "__which"]
    inside = _inside(long, middle_bins(long, names, bin_rows), names)
    counts = inside.groupBy(*group, "lo", "below", "all", "__value").agg(F.count(F.lit(1)).alias("n"))
    low, high = _div(F.col("all") - 1, 2), _div(F.col("all"), 2)
    over = Window.partitionBy(*group, "lo").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("below") + F.sum("n").over(over)
    halves = []
    for i, out in enumerate(columns.values()):
        here = F.col("__which") == i
        first = F.max(F.when(here & (low < F.col("upto")) & (low >= F.col("upto") - F.col("n")), value))
        second = F.max(F.when(here & (high < F.col("upto")) & (high >= F.col("upto") - F.col("n")), value))
        halves.append(((first + second) / 2).alias(out))
    found = counts.withColumn("upto", upto).groupBy(*names).agg(*halves)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)],
                        *[ref(out) for out in columns.values()])
