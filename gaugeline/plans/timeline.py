"""Windows over long series without long window partitions.

A window partitioned by series alone puts a whole series into one task. Here every window is
partitioned by (series, time bucket), and what a bucket needs from the buckets before or after it
arrives as one extra *carry row*:

1. fold the rows of each (series, bucket) into one summary row (combined on the map side);
2. run over the summaries of a series, at most time span / bucket width rows;
3. add the result to the bucket as a carry row that sorts before the real rows.

No join and no broadcast. The rows are shuffled once, but read twice, once for the fold, which moves
summaries only. Whoever chains several of these operators writes the table in between
(`session.settle`), as `plans/lake.py` does; else each reading repeats all steps before it.

Buckets have one width, except where a series has a burst: `Buckets` lists the few stretches that hold
more rows than a task should get, with the narrower width of each. What a bucket learns from others goes
by their order alone, so it does not matter how wide they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.time import bucket_of, position, ref, sql_text, width_micros
from gaugeline.session import settle

POS = "__pos"
BUCKET = "__bucket"
CARRY = "__carry"
HOME = "__home"
ASC = "__asc"
DESC = "__desc"
PICKED = "__picked"

DEFAULT_BUCKET = "1 day"
BUCKET_LADDER = ("365 days", "30 days", "1 day", "1 hour", "1 minute", "1 second")
ROWS_PER_BUCKET = 5_000_000


@dataclass(frozen=True)
class Carry:
    """What a bucket learns from the other buckets of its series."""

    name: str
    fold: Column
    merge: Callable[[Column], Column]
    #: "before", "after", "all", or the first and last of a range of buckets, relative to the bucket.
    reach: str | tuple[int, int] = "before"


def with_carries(rows: DataFrame, carries: Sequence[Carry], keys: Sequence[str]) -> DataFrame:
    """`rows` (which hold `BUCKET`) plus one carry row for each bucket of each series."""
    marked = rows.withColumn(CARRY, F.lit(False))
    if not carries:
        return marked
    series = [ref(k) for k in keys]
    folded = rows.groupBy(*series, BUCKET).agg(*[c.fold.alias(c.name) for c in carries])
    windows = {
        "before": Window.partitionBy(*series).orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1),
        "after": Window.partitionBy(*series).orderBy(F.col(BUCKET).desc())
        .rowsBetween(Window.unboundedPreceding, -1),
        "all": Window.partitionBy(*series).orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }
    by_number = Window.partitionBy(*series).orderBy(BUCKET)
    windows |= {c.reach: by_number.rangeBetween(*c.reach) for c in carries if isinstance(c.reach, tuple)}
    carry_rows = folded.select(
        *series,
        BUCKET,
        F.lit(True).alias(CARRY),
        *[c.merge(F.col(c.name)).over(windows[c.reach]).alias(c.name) for c in carries],
    )
    return marked.unionByName(carry_rows, allowMissingColumns=True)


@dataclass(frozen=True)
class Buckets:
    """Stretches of one width, and the narrower width of those that are too full.

    `dense` has a row (keys, cell, width) for each stretch, by its number, that is cut; there are at most
    as many as the table has rows, over the row limit of a bucket, so it may be sent to all tasks.
    """

    width: int
    keys: tuple[str, ...]
    dense: DataFrame


def with_starts(df: DataFrame, buckets: Buckets, keys: Sequence[str], places: dict[str, str]) -> DataFrame:
    """For each position (SQL) of `places` the start of the bucket that holds it, under its name."""
    if tuple(keys) != buckets.keys:
        raise ValueError(f"Buckets of {buckets.keys} do not serve {tuple(keys)}")
    for name, at in places.items():
        dense = buckets.dense.toDF(*[f"{name}k{i}" for i in range(len(keys))], f"{name}cell", f"{name}width")
        on = bucket_of(at, buckets.width) == F.col(f"{name}cell")
        for i, k in enumerate(keys):
            on = on & ref(k).eqNullSafe(F.col(f"{name}k{i}"))
        inside = f"pmod({at}, {buckets.width}L)"
        step = f"coalesce({name}width, {buckets.width}L)"
        start = F.expr(f"({at}) - {inside} + ({inside} div {step}) * {step}")
        df = df.join(F.broadcast(dense), on, "left").withColumn(name, start).drop(*dense.columns)
    return df


def bucketed(df: DataFrame, ts: str, keys: Sequence[str], bucket: str | int | Buckets) -> DataFrame:
    """Rows that have a time, with their position and bucket."""
    width = resolve_bucket(df, ts, keys, bucket)
    dated = df.where(ref(ts).isNotNull()).withColumn(POS, position(df, ts))
    if isinstance(width, Buckets):
        return with_starts(dated, width, keys, {BUCKET: POS})
    return dated.withColumn(BUCKET, bucket_of(POS, width))


def row_order(keys: Sequence[str], tiebreak: Sequence[str]) -> WindowSpec:
    """Row order inside a bucket; the carry row has no position and comes first."""
    return Window.partitionBy(*[ref(k) for k in keys], BUCKET).orderBy(
        F.col(POS).asc_nulls_first(), *[ref(c) for c in tiebreak]
    )


def resolve_bucket(df: DataFrame, ts: str, keys: Sequence[str], bucket: str | int | Buckets) -> int | Buckets:
    """Bucket width in microseconds; `"auto"` measures the table first."""
    if bucket == "auto":
        return suggest_buckets(df, ts, keys)
    return bucket if isinstance(bucket, Buckets) else width_micros(bucket)


def _minutes(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """Rows by (series, minute), counted on the map side in one pass."""
    least = width_micros(BUCKET_LADDER[-2])
    return settle(
        df.where(ref(ts).isNotNull()).withColumn(POS, position(df, ts))
        .groupBy(*[ref(k) for k in keys], bucket_of(POS, least).alias("__cell"))
        .agg(F.count(F.lit(1)).alias("__rows"))
    )


def _steps(counts: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The counts of `_minutes` added up by a wider step."""
    cell = bucket_of(f"__cell * {width_micros(BUCKET_LADDER[-2])}L", width).alias(BUCKET)
    return counts.groupBy(*[ref(k) for k in keys], cell).agg(F.sum("__rows").alias("__rows"))


def suggest_bucket(
    df: DataFrame, ts: str, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> str:
    """The widest bucket of the ladder whose fullest (series, bucket) stays under the row limit.

    The table is read once: rows are counted by (series, minute) on the map side, and the wider
    steps add up these counts.
    """
    counts = _minutes(df, ts, keys)
    for step in BUCKET_LADDER[:-1]:
        fullest = _steps(counts, keys, width_micros(step)).agg(F.max("__rows")).first()[0]
        if (fullest or 0) <= rows_per_bucket:
            return step
    return BUCKET_LADDER[-1]


def suggest_buckets(
    df: DataFrame, ts: str, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> int | Buckets:
    """The widest step of the ladder at which at most one (series, bucket) in a hundred is over the
    row limit; those are cut on their own, so a burst in one series leaves the others alone."""
    counts = _minutes(df, ts, keys)
    for step in BUCKET_LADDER[:-1]:
        width = width_micros(step)
        over, every = _steps(counts, keys, width).agg(
            F.count_if(F.col("__rows") > rows_per_bucket), F.count(F.lit(1))).first()
        if over * 100 <= every:
            return cut_buckets(df, ts, keys, width, rows_per_bucket) if over else width
    return cut_buckets(df, ts, keys, width_micros(BUCKET_LADDER[-2]), rows_per_bucket)


def cut_buckets(
    df: DataFrame, ts: str, keys: Sequence[str], bucket: str | int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> int | Buckets:
    """Buckets of a width, those over the row limit cut into equal parts, each time four for one, until
    the fullest part is under it, or until parts are a 4^9th. Rows of one series at one time stay together.

    Two passes over the table: one counts by (series, bucket); one, over the rows of full buckets only,
    by their smallest parts, whose counts give those of all wider ones.
    """
    width = width_micros(bucket)
    series = [f"__d{i}" for i in range(len(keys))]
    rows = df.where(ref(ts).isNotNull()).select(
        *[ref(k).alias(d) for k, d in zip(keys, series)], position(df, ts).alias(POS))
    cells = rows.groupBy(*series, bucket_of(POS, width).alias("__cell")).agg(F.count(F.lit(1)).alias("__rows"))
    full = settle(cells.where(F.col("__rows") > rows_per_bucket).select(*series, "__cell"))
    if full.isEmpty():
        return width
    least = -(-width // 4**9)
    steps = [least * 4**i for i in range(9)]
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*series, "__cell"]]
    on = same[0]
    for more in same[1:]:
        on = on & more
    parts = (
        rows.withColumn("__cell", bucket_of(POS, width)).alias("r").join(F.broadcast(full).alias("f"), on, "left_semi")
        .groupBy(*series, "__cell", F.expr(f"pmod({POS}, {width}L) div {least}L").alias("__part"))
        .agg(F.count(F.lit(1)).alias("__rows")))
    by_step = parts.withColumn("__step", F.explode(F.array(*[F.lit(x).cast("bigint") for x in steps])))
    counted = by_step.groupBy(*series, "__cell", "__step", F.expr(f"__part div (__step div {least}L)").alias("__part")).agg(
        F.sum("__rows").alias("__rows"))
    fits = counted.groupBy(*series, "__cell", "__step").agg(F.max("__rows").alias("__rows"))
    best = fits.groupBy(*series, "__cell").agg(F.coalesce(
        F.max(F.when(F.col("__rows") <= rows_per_bucket, F.col("__step"))), F.min("__step")).alias("__width"))
    return Buckets(width, tuple(keys), settle(best))


@dataclass(frozen=True)
class Lookup:
    """The last candidate row at or before `t - offset`, or the first at or after `t + offset`."""

    out: str
    offset: int
    forward: bool = False

    @property
    def shift(self) -> int:
        return -self.offset if self.forward else self.offset


@dataclass(frozen=True)
class RollingSum:
    """Sum of `column` over `(t - span, t]`, rows of equal time included; missing if all missing.

    Whole numbers and decimals are exact. Other numbers are only ever added, never taken off a
    running total, so a large or infinite value leaves nothing behind once it is out of the span.
    """

    out: str
    column: str
    span: int


def order_number(tiebreak: Sequence[Column], kinds: Sequence[T.DataType]) -> Column | None:
    """Position and tiebreak as one number of fixed width, or None if they do not fit into one.

    A maximum by such a number is a hash aggregate; by a struct it is a sort of all rows.
    """
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if not tiebreak:
        return F.col(POS)
    if len(tiebreak) > 1 or not isinstance(kinds[0], whole):
        return None
    # A missing tiebreak comes first.
    tie = F.coalesce(tiebreak[0].cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    return F.col(POS).cast("decimal(18,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + tie


def fold_last(
    eligible: Column, sources: Sequence[Column], tiebreak: Sequence[Column],
    kinds: Sequence[T.DataType], first: bool = False,
) -> Column:
    """The struct (at, tie.., v..) of the last eligible row of a group, or of the first."""
    pick, pick_by = (F.min, F.min_by) if first else (F.max, F.max_by)
    fields = [*[(f"tie{i}", c) for i, c in enumerate(tiebreak)],
              *[(f"v{i}", c) for i, c in enumerate(sources)]]
    order = order_number(tiebreak, kinds)
    if order is None:
        row = F.struct(F.col(POS).alias("at"), *[c.alias(n) for n, c in fields])
        return pick(F.when(eligible, row))
    order = F.when(eligible, order)
    return F.when(
        F.max(F.when(eligible, F.col(POS))).isNotNull(),
        F.struct(pick(F.when(eligible, F.col(POS))).alias("at"),
                 *[pick_by(c, order).alias(n) for n, c in fields]),
    )


def look_up(
    df: DataFrame,
    *,
    ts: str,
    sources: Sequence[str] = (),
    lookups: Sequence[Lookup] = (),
    sums: Sequence[RollingSum] = (),
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    where: Column | None = None,
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Add a struct of `sources` for each lookup and a column for each rolling sum, in one shuffle.

    Rows without time are dropped. A lookup picks its row first and reads the values after, so a
    missing value in the picked row stays missing. Among rows of equal time, backward lookups take
    the last and forward lookups the first by `tiebreak`. There is no tolerance.

    A row `s` can answer questions asked at `s + offset` (backward) or `s - offset` (forward). It
    is copied, without its other columns, into the buckets of those times when they differ from
    its own; rows that fall even earlier (or later) reach a bucket through its carry row. So the
    bucket may be narrower or wider than the offsets. With rolling sums of floating numbers all
    buckets have one width.
    """
    width = resolve_bucket(df, ts, keys, bucket)
    # Sums that are only added up want buckets no wider than their span.
    added = [s for s in sums if isinstance(df.schema[s.column].dataType, (T.DoubleType, T.FloatType))]
    cut = width if isinstance(width, Buckets) and not added else None
    width = min([width.width if isinstance(width, Buckets) else width, *[s.span for s in added]])
    sums = [s for s in sums if s not in added]
    shifts = sorted({0} | {x.shift for x in lookups} | {s.span for s in [*sums, *added]})
    far = max(abs(s) for s in shifts) + 1
    columns = df.columns
    narrow = list(dict.fromkeys([*keys, *tiebreak, *sources, *[s.column for s in [*sums, *added]]]))
    cell = {c: ref(c) for c in dict.fromkeys([*columns, *narrow])}
    pos, home, carry = F.col(POS), F.col(HOME), F.col(CARRY)
    target = {shift: bucket_of(f"{POS} + {shift}L", width) for shift in shifts}
    if cut:
        target = {shift: F.col(f"__t{i}") for i, shift in enumerate(shifts)}
    here = {shift: F.col(BUCKET) == target[shift] for shift in shifts}
    # Buckets of several widths cannot be worked out again later; one bit a shift goes with the row.
    seen = {s: F.expr(f"__seen & {1 << i} <> 0") for i, s in enumerate(shifts)} if cut else here
    # A lookup that only asks when needs no struct, and its summaries are plain hash aggregates.
    picked = pos
    if sources:
        picked = F.struct(
            pos.alias("at"),
            *[cell[c].alias(f"tie{i}") for i, c in enumerate(tiebreak)],
            *[cell[c].alias(f"v{i}") for i, c in enumerate(sources)],
        )
    candidate = F.lit(True) if where is None else F.coalesce(where, F.lit(False))

    # Buckets rise with the shift, so a repeated one equals the one before it.
    places = [target[shifts[0]]]
    places += [F.nullif(target[b], target[a]) for a, b in zip(shifts, shifts[1:])]
    dated = df.where(cell[ts].isNotNull()).select("*", position(df, ts).alias(POS), candidate.alias("__cand"))
    bits = []
    if cut:
        dated = with_starts(dated, cut, keys, {f"__t{i}": f"{POS} + {s}L" for i, s in enumerate(shifts)})
        bits = [sum((F.when(here[s], 1 << i).otherwise(0) for i, s in enumerate(shifts)), F.lit(0)).alias("__seen")]
    placed = (
        dated.withColumn(BUCKET, F.explode(F.array(*places)))
        .where(F.col(BUCKET).isNotNull())
        .withColumn(HOME, here[0])
        .select(
            *bits,
            *[cell[c] for c in narrow],
            *[F.when(home, cell[c]).alias(c) for c in columns if c not in narrow],
            POS, BUCKET, HOME, *[F.when(F.col("__cand"), picked).alias(PICKED)] * bool(lookups),
        )
    )

    kinds = [df.schema[c].dataType for c in tiebreak]

    def fold(x: Lookup) -> Column:
        eligible = seen[x.shift] & F.col(PICKED).isNotNull()
        if not sources:
            return (F.min if x.forward else F.max)(F.when(eligible, pos))
        return fold_last(eligible, [cell[c] for c in sources], [cell[c] for c in tiebreak], kinds, x.forward)

    carries = [
        Carry(f"__c{i}", fold(x), F.min if x.forward else F.max, "after" if x.forward else "before")
        for i, x in enumerate(lookups)
    ]
    # A rolling sum is the running total up to `t` less the one up to `t - span`. In a bucket at
    # least as wide as the span both run over the rows present; in a narrower one each starts from
    # the total carried in. `totals` names the running
    # totals, `parts` holds what each adds up and `ends` the two that make up a sum.
    totals: dict[tuple[str, int, bool], str] = {}
    parts: dict[str, Column] = {}
    ends: list[list[tuple[str, int]]] = []
    for s in sums:
        local = s.span <= width and not cut
        names = []
        for shift in (0, s.span):
            tag = (s.column, s.span if local else shift, local)
            name = totals.setdefault(tag, f"__s{len(totals)}")
            mask = seen[0] | seen[s.span] if local else seen[shift]
            if name not in parts:
                parts[name] = F.when(mask, cell[s.column])
                if not local:
                    carries.append(Carry(name, F.sum(parts[name]), F.sum))
                    carries.append(Carry(name + "n", F.count(parts[name]), F.sum))
            names.append((name, shift))
        ends.append(names)

    # A sum that is only added up has three parts: this bucket's rows up to `t`; the copies of rows
    # that leave the span within this bucket, and have not left at `t`; and all rows in between.
    for i, s in enumerate(added):
        q = s.span // width
        carries.append(Carry(f"__e{i}", F.sum(F.when(home & (target[s.span] == F.col(BUCKET) + q + 1),
                                                     cell[s.column])), F.sum, (-q, -q)))
        if q > 1:
            carries.append(Carry(f"__m{i}", F.sum(F.when(home, cell[s.column])), F.sum, (1 - q, -1)))

    # A carry row stands before all that its bucket can ask for.
    first = f"-{1 << 61}L" if cut else f"{BUCKET} * {width}L - {far}L"
    last = f"-{1 << 61}L" if cut else f"-({BUCKET} + 1) * {width}L - {far}L"
    rows = with_carries(placed, carries, keys).select(
        "*",
        F.expr(f"if({CARRY}, {first}, {POS})").alias(ASC),
        F.expr(f"if({CARRY}, {last}, -{POS})").alias(DESC),
    )
    part = Window.partitionBy(*[cell[k] for k in keys], BUCKET)

    def upto(order: str, offset: int) -> WindowSpec:
        return part.orderBy(order).rangeBetween(Window.unboundedPreceding, -offset)

    result: list[Column] = []
    for i, x in enumerate(lookups):
        frame = upto(DESC if x.forward else ASC, x.offset)
        best, better = (F.min, F.least) if x.forward else (F.max, F.greatest)
        near, far_off = best(F.col(PICKED)).over(frame), best(F.col(f"__c{i}")).over(frame)
        result.append(better(near, far_off).alias(f"__r{i}"))
    carried = {c.name for c in carries}
    for name, shift in dict.fromkeys(pair for pairs in ends for pair in pairs):
        value, count = parts[name], parts[name].isNotNull().cast("bigint")
        if name in carried:
            value = F.when(carry, F.col(name)).otherwise(value)
            count = F.when(carry, F.col(name + "n")).otherwise(count)
        frame = upto(ASC, shift)
        result.append(F.sum(value).over(frame).alias(f"{name}v{shift}"))
        result.append(F.sum(count).over(frame).alias(f"{name}k{shift}"))

    for i, s in enumerate(added):
        value = cell[s.column]
        leaving = -F.when(seen[s.span], pos + s.span).when(home, pos)
        still = part.orderBy(leaving.asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
        result += [
            F.sum(F.when(home, value)).over(upto(ASC, 0)).alias(f"__own{i}"),
            F.sum(F.when(seen[s.span] & ~carry, value)).over(still).alias(f"__tail{i}"),
            F.max(f"__e{i}").over(part).alias(f"__edge{i}"),
            (F.max(f"__m{i}").over(part) if s.span // width > 1 else F.lit(None).cast("double"))
            .alias(f"__mid{i}"),
        ]

    answered = rows.select("*", *result).where(~carry & home)
    out: list[Column] = [cell[c] for c in columns]
    for i, x in enumerate(lookups):
        fields = [f"'at', __r{i}{'.at' if sources else ''}"]
        fields += [f"{sql_text(c)}, __r{i}.v{j}" for j, c in enumerate(sources)]
        found = F.expr(f"if(__r{i} IS NOT NULL, named_struct({', '.join(fields)}), NULL)")
        out.append(found.alias(x.out))
    for s, ((now, zero), (then, span)) in zip(sums, ends):
        out.append(
            F.expr(
                f"if({now}k{zero} > coalesce({then}k{span}, 0), "
                f"{now}v{zero} - coalesce({then}v{span}, 0), NULL)"
            ).alias(s.out)
        )
    for i, s in enumerate(added):
        terms = [F.col(f"__{n}{i}") for n in ("tail", "edge", "mid", "own")]
        total = sum((F.coalesce(x, F.lit(0.0)) for x in terms), F.lit(0.0))
        out.append(F.when(F.coalesce(*terms).isNotNull(), total).alias(s.out))
    return answered.select(*out)
