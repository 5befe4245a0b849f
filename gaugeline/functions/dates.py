"""Dates whose layout is found from the column itself.

A text is mapped to its shape: what its digits, letters and marks are, not which. One pass counts the
shapes of a column with the largest number at each place; the shapes that are dates have a grammar, so
there are few of them however long the table is. Each shape then has one parser, and whether a day or a
month comes first is settled by all rows of the column together.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.time import quoted, ref
from gaugeline.functions.values import last_century, timestamp

_WEEKDAY = r"(?:mon|tue|wed|thu|fri|sat|sun)(?:day|sday|nesday|rsday|urday)?"
_MONTH = r"(?:january|february|march|april|june|july|august|september|october|november|december)"
_SHORT_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_HALF_DAY = r"(?:[ap]m|[ap]\.m\.)"
# The signs of a shape, and the texts they stand for, in the order in which they are looked for. Texts
# are in lower case, so signs are never taken for letters of the text.
_SIGNS = {
    "W": _WEEKDAY + r"(?![a-z])",
    "B": _MONTH,
    "S": _SHORT_MONTH + r"(?![a-z])",
    "P": r"(?<=[0-9 ])" + _HALF_DAY + r"(?![a-z])",
    "T": r"(?<=[0-9])t(?=[0-9])",
    "Z": r"(?<=[0-9])z$",
    "F": r"(?<=:[0-9]{2})\.[0-9]{1,9}(?![0-9])",
    "E": r"(?<![0-9])[0-9]{14}(?![0-9])",
    "D": r"(?<![0-9])[0-9]{8}(?![0-9])",
    "Y": r"(?<![0-9])[0-9]{4}(?![0-9])",
    "N": r"(?<![0-9])[0-9]{1,2}(?![0-9])",
}
_BODY = {"W": _WEEKDAY, "B": _MONTH, "S": _SHORT_MONTH, "P": _HALF_DAY, "F": r"\.[0-9]{1,9}", "T": "t",
         "E": "[0-9]{14}", "D": "[0-9]{8}", "Y": "[0-9]{4}", "N": "[0-9]{1,2}", "Z": "z"}
_NUMBERS = "FEDYN"
_FIELDS = r"[NYBS](?:, ?|[ /.-])[NYBS](?:, ?|[ /.-])[NYBS]"
_DATE = rf"(?:(?:W,? )?{_FIELDS}|D)"
_TIME = r"N:N(?::NF?)?(?: ?P)?"
_GRAMMAR = (rf"^(?:{_DATE}(?:(?:, | |T){_TIME})?|{_TIME}(?:, | ){_DATE}|E"
            r"|Y-N-N[T ]N:N(?::NF?)? ?(?:Z|[+-]N(?::N)?|[+-]Y))$")
_ISO = re.compile(r"Y-N-N(?:[T ]N:N(?::NF?)? ?(?:Z|[+-]N(?::N)?|[+-]Y)?)?$")
#: Minutes and seconds of a time that stands first are no fields of the date.
_DATE_PART = re.compile(rf"(?<!:){_FIELDS}")
_MOST_NUMBERS = 8
#: Orders of month, day and year, the first that suits a column being taken.
ORDERS = ("mdy", "dmy", "ymd", "ydm", "myd", "dym")


@dataclass(frozen=True)
class DateShape:
    """One shape of a column: its rows, the orders tried in turn, and how the order was settled.

    `decided` is "only" (the shape has one order), "values" (numbers rule the swapped order out), "given",
    "assumed" (day and month could be swapped in all rows) or "mixed" (no order suits all rows, so each
    value takes the first that suits it).
    """

    shape: str
    rows: int
    orders: tuple[str, ...]
    decided: str


@dataclass(frozen=True)
class DateReading:
    """How a column of texts is read. Applies to any table with a column of the same layout."""

    shapes: tuple[DateShape, ...]
    rows: int
    unknown: int

    def column(self, name: str) -> Column:
        """The text column `name` as a time without zone; what has no known shape is tried as ISO."""
        text = _text(name)
        iso = F.expr(f"try_cast(trim({quoted(name)}) AS TIMESTAMP_NTZ)")
        result = None
        for s in self.shapes:
            fits = F.rlike(text, F.lit(_pattern(s.shape)))
            value = F.coalesce(*[_parsed(text, iso, s.shape, order) for order in s.orders])
            result = F.when(fits, value) if result is None else result.when(fits, value)
        return iso if result is None else result.otherwise(iso)

    def report(self, spark: SparkSession) -> DataFrame:
        """One row for each shape: its rows, its order or orders, and how that was settled."""
        rows = [(s.shape, s.rows, " ".join(s.orders), s.decided) for s in self.shapes]
        rows += [("", self.unknown, "", "unknown")] * bool(self.unknown)
        return spark.createDataFrame(rows, "shape string, rows bigint, orders string, decided string")


def _text(name: str) -> Column:
    return F.regexp_replace(F.trim(ref(name)), r"\s+", " ")


def shape_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows by shape with the largest number at each place; `shape` is missing where there is no date.

    Rows are counted by their text with all digits alike, combined in the tasks; only those few texts
    are then turned into signs.
    """
    text = _text(name)
    maybe = F.rlike(text, F.lit(r"^[0-9A-Za-z ,.:/+-]{6,48}$"))
    numbers = F.when(maybe, F.regexp_extract_all(text, F.lit("([0-9]+)"), 1))
    places = [f"n{i}" for i in range(_MOST_NUMBERS)]
    alike = df.where(ref(name).isNotNull()).select(
        F.when(maybe, F.translate(F.lower(text), "123456789", "0" * 9)).alias("alike"), numbers.alias("numbers"))
    counts = alike.groupBy("alike").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.max(F.expr(f"try_cast(get(numbers, {i}) AS INT)")).alias(p) for i, p in enumerate(places)])
    shape = F.col("alike")
    for sign, found in _SIGNS.items():
        shape = F.regexp_replace(shape, found, sign)
    signs = counts.withColumn("shape", shape)
    known = F.when(F.rlike(F.col("shape"), F.lit(_GRAMMAR)), F.col("shape"))
    return signs.groupBy(known.alias("shape")).agg(
        F.sum("rows").alias("rows"), *[F.max(p).alias(p) for p in places])


def read_dates(df: DataFrame, name: str, order: str | None = None) -> DateReading:
    """Find how the texts of a column are read, in one pass over that column.

    `order`, one of `ORDERS`, is taken wherever a shape allows it. Otherwise shapes with the same date
    part take the first order that no number of theirs rules out. Missing texts are not counted.
    """
    if order is not None and order not in ORDERS:
        raise ValueError(f"Not an order: {order!r}; one of {ORDERS}")
    counted = shape_counts(df, name).collect()  # As many rows as the grammar has shapes, at most.
    known = sorted((r for r in counted if r["shape"]), key=lambda r: (-r["rows"], r["shape"]))
    largest: dict[str, list[int]] = {}
    for r in known:
        part, places = _date_part(r["shape"])
        now = [r[f"n{i}"] or 0 if i is not None else 0 for i in places]
        largest[part] = [max(a, b) for a, b in zip(now, largest.get(part, now))]
    shapes = []
    for r in known:
        part, _ = _date_part(r["shape"])
        orders, decided = _decide(_kinds(part), largest[part], order)
        if orders:
            shapes.append(DateShape(r["shape"], r["rows"], orders, decided))
    total = sum(r["rows"] for r in counted)
    return DateReading(tuple(shapes), total, total - sum(s.rows for s in shapes))


def with_dates(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """The column as times, its layout found from the whole column. Columns of other types and streams,
    which cannot be read twice, go row by row through the fixed layouts of `values.timestamp`."""
    if df.isStreaming or not isinstance(df.schema[name].dataType, T.StringType):
        return df.withColumn(name, timestamp(df, name))
    return df.withColumn(name, read_dates(df, name, order).column(name))


def _date_part(shape: str) -> tuple[str, list[int | None]]:
    """The date in a shape, and the number (from 0) that each of its fields is in the text."""
    found = _DATE_PART.search(shape) or re.search("[DE]", shape)
    before = sum(c in _NUMBERS for c in shape[:found.start()])
    places: list[int | None] = []
    for c in _kinds(found.group()):
        places.append(before if c in _NUMBERS else None)
        before += c in _NUMBERS
    return found.group(), places


def _kinds(part: str) -> str:
    return "".join(c for c in part if c in "NYBSDE")


def _decide(kinds: str, largest: Sequence[int], given: str | None) -> tuple[tuple[str, ...], str]:
    if kinds in ("D", "E"):
        return ("ymd",), "only"
    allowed = [o for o in ORDERS if _allowed(o, kinds)]
    if given in allowed:
        return (given,), "given"
    if len(allowed) < 2:
        return tuple(allowed), "only"
    limit = {"m": 12, "d": 31, "y": 9999}
    suits = [o for o in allowed if all(n <= limit[c] for c, n in zip(o, largest))]
    if not suits:
        return tuple(allowed), "mixed"
    swapped = suits[0].translate(str.maketrans("dm", "md"))
    return (suits[0],), "assumed" if swapped in suits[1:] else "values"


def _allowed(order: str, kinds: str) -> bool:
    """Four digits are the year, a name is the month, and there is one of each."""
    return all((role == "y") if kind == "Y" else (role == "m") if kind in "BS" else
               (role == "d" or role == "m" and not set(kinds) & set("BS") or role == "y" and "Y" not in kinds)
               for role, kind in zip(order, kinds))


def _pattern(shape: str) -> str:
    return "(?i)^" + "".join(_BODY.get(c) or re.escape(c) for c in shape) + "$"


def _parsed(text: Column, iso: Column, shape: str, order: str) -> Column:
    """Texts of one shape by one formatter, day, month and year in the given order."""
    if order == "ymd" and _ISO.match(shape):
        return iso
    if "W" in shape:
        text = F.regexp_replace(text, rf"(?i)(?<![a-z]){_WEEKDAY},? ", "")
    if "P" in shape:
        text = F.regexp_replace(text, r"(?i)([ap])\.m\.", "$1m")
    letters, half = _letters(shape, order)
    when = F.try_to_timestamp(text, F.lit(letters.replace("H", "h") if half else letters)).cast("timestamp_ntz")
    return last_century(when) if "yy" in letters and "yyyy" not in letters else when


def _letters(shape: str, order: str) -> tuple[str, bool]:
    """The formatter's letters of a shape, and whether it has a half of the day."""
    plain = re.sub("W,? ", "", shape)
    date = _DATE_PART.search(plain)
    inside = range(*date.span()) if date else ()
    roles, clock, out = list(order), list("Hms"), ""
    for i, c in enumerate(plain):
        if c == "E":
            out += "yyyyMMddHHmmss"
        elif c == "D":
            out += "yyyyMMdd"
        elif c in "NYBS" and i in inside:
            number = {"y": "yy", "m": "M", "d": "d"}[roles.pop(0)]
            out += {"Y": "yyyy", "B": "MMMM", "S": "MMM", "N": number}[c]
        elif c == "N":
            out += clock.pop(0)
        else:
            out += {"F": ".SSSSSSSSS", "P": "a", "T": "'T'"}.get(c, c)
    return out, "P" in shape
