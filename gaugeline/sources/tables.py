"""CSV in, CSV and JSON out."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.columns import targets, trim_names
from gaugeline.functions.time import ref
from gaugeline.sources.quoted import cells, csv_records

# Texts that stand for a missing cell.
MISSING_TEXTS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _scan(spark: SparkSession, path: str | list[str], multi_line: bool = False, **options: str) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').options(**options)
    reader = reader.option("multiLine", multi_line).option("enforceSchema", False)
    return _found(reader.csv, path)


def _rows(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The scan, or, where quoted cells may hold line breaks, records put together split by split."""
    if not multi_line:
        return _scan(spark, path)
    names = _scan(spark, path, True).columns  # From the first record; nothing else is read.
    return cells(csv_records(spark, path), names)


def _found(read: Callable[..., DataFrame], path: str | list[str]) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Input not found: {path}") from error
        raise


def read_text_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every cell as the text it is; only an empty cell becomes an empty string."""
    df = _rows(spark, path, multi_line)
    return trim_names(df.select(*[F.coalesce(ref(c), F.lit("")).alias(c) for c in df.columns]))


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Text columns with trimmed names; texts for a missing cell become missing.

    No type is inferred, which would be a second pass over the data; the operators turn the
    columns they use into numbers and times. With `multi_line` a quoted cell may hold line breaks
    (`sources/quoted.py`); a file is then still read by several tasks, but read twice.
    """
    df = _rows(spark, path, multi_line)
    cells = [F.when(~ref(c).isin(*MISSING_TEXTS), ref(c)).alias(c) for c in df.columns]
    return trim_names(df.select(*cells))


_CSV = "*.[cC][sS][vV]"


def read_series_folder(
    spark: SparkSession, folder: str, series: str = "series", mixed: bool = False
) -> DataFrame:
    """All CSV files of a folder as one table; the file's stem names the series.

    A file in a sub-folder `<series>=<name>`, as `write_by_series` writes them, belongs to that name,
    so a series may have several files. Files of other kinds are left alone. The CSV files must share
    one header; a file with another header raises while it is read. With `mixed`, each file is read by
    its own header, and a column that it lacks is missing in its rows.
    """
    if not mixed:
        return _series(_scan(spark, folder, pathGlobFilter=_CSV, recursiveFileLookup="true"), series)
    parts = [_series(_scan(spark, paths), series) for paths in _by_header(spark, folder)]
    if not parts:
        raise FileNotFoundError(f"No CSV files in {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _series(df: DataFrame, series: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    inside = F.regexp_extract(path, rf"/{re.escape(series)}=([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    # Sub-folder names are escaped twice: once as a name, once as a part of the path.
    name = F.when(inside != "", _unescaped(_unescaped(inside))).otherwise(_unescaped(stem))
    cells = [F.when(~ref(c).isin(*MISSING_TEXTS), ref(c)).alias(c.strip()) for c in df.columns]
    return df.select(name.alias(series), *cells)


def _unescaped(text: Column) -> Column:
    """Percent signs undone; a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _by_header(spark: SparkSession, folder: str) -> list[list[str]]:
    """Paths of the CSV files by header, in one pass: tasks keep the first line of each file."""
    lines = _found(spark.read.option("pathGlobFilter", _CSV).option("recursiveFileLookup", True).text, folder)
    heads = (
        lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"),
                     F.col("_metadata.file_block_start").alias("begin"))
        .where("begin = 0").groupBy("path").agg(F.min_by("value", "at").alias("head")))
    # Spark lists the files of a scan on the driver, so their paths have room there.
    grouped = heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [[_literal(path) for path in r["paths"]] for r in grouped.orderBy("head").collect()]


def _literal(path: str) -> str:
    """A file's path from its metadata as a path to read: nothing escaped, nothing a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(path))


def table_size(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def peek_targets(spark: SparkSession, path: str) -> list[str]:
    """Trainable columns of a file, from its header alone."""
    return targets([c.strip() for c in _scan(spark, path).columns])


def default_output(path: str, suffix: str) -> str:
    """`<stem><suffix><extension>` next to the input; without extension, `.csv`."""
    stem, extension = os.path.splitext(path.rstrip("/"))
    return f"{stem}{suffix}{extension or '.csv'}"


def _normal(path: str) -> str:
    scheme, colon, rest = path.partition("://")
    if colon and scheme != "file":
        return f"{scheme}://{os.path.normpath(rest)}"
    return os.path.abspath(rest if colon else path.removeprefix("file:"))


def write_table(df: DataFrame, path: str, source: str | None = None, *,
                order_by: str | None = None) -> str:
    """Write CSV with header to `path` (`.csv` is added); the input is never overwritten."""
    if not path.lower().endswith(".csv"):
        path += ".csv"
    if source is not None and _normal(path) == _normal(source):
        raise ValueError(f"The output would overwrite the input: {source}")
    out = df.orderBy(ref(order_by)) if order_by else df
    out.write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)
    return path


def write_reports(reports: Mapping[str, DataFrame], folder: str, source: str | None = None,
                  *, order_by: str | None = None) -> dict[str, str]:
    """Write each named table into `folder`; returns the paths by name."""
    return {
        name: write_table(df, f"{folder.rstrip('/')}/{name}", source, order_by=order_by)
        for name, df in reports.items()
    }


def write_by_series(
    df: DataFrame, folder: str, series: str = "series", order_by: str | None = None
) -> str:
    """One sub-folder for each series, its rows by `order_by`. A scanned folder cannot be rewritten
    in place, so a new one is needed.

    Rows are dealt out by ranges of (series, order), so a series lies in few tasks and files, in
    order, and a long one is still spread over several.
    """
    order = [ref(c) for c in (series, order_by) if c]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.partitionBy(series).option("header", True).mode("errorifexists").csv(folder)
    return folder


def write_metrics(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").json(path)
    return path
