"""Saved models as rows of an append-only table.

Every row of a name carries a version. A writer claims the number after the highest claimed so far by
creating a file that must not exist yet, then adds its row; the row with the highest version counts.
Clocks play no part. Where a store lets two writers create the file at once, as a local disk may, both
have one version and are told apart by a random claim in their rows, the same way by every reader.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import asdict

from py4j.protocol import Py4JJavaError

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.operators.boosting import Node, QuantileModel

# Fixed value: characters a model name may not hold.
UNSAFE = r"[^\w.\-]+"

_FIELDS = {
    "name": "string",
    "live": "boolean",
    "saved_at": "timestamp",
    "target": "string",
    "features": "array<string>",
    "medians": "array<double>",
    "base": "double",
    "alpha": "double",
    "label": "string",
    "mode": "string",
    "mae": "double",
    "mae_validation": "double",
    "train_rows": "bigint",
    "validation_rows": "bigint",
    "test_rows": "bigint",
    "trees": "array<array<struct<feature:int,threshold:double,left:int,right:int,value:double>>>",
    "version": "bigint",
    "claim": "string",
}
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())


def model_name(target: str, label: str) -> str:
    return f"model_{re.sub(UNSAFE, '_', target)}_quantile_{label}"


def _claimed(spark: SparkSession, folder: str, name: str) -> int:
    """A version of `name` that no other writer has: files starting with `_` are no part of the table."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_versions/{re.sub(UNSAFE, '_', name)}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    version = max((int(f.getPath().getName()) for f in files.listStatus(place)), default=0) + 1
    while True:
        try:
            files.create(jvm.org.apache.hadoop.fs.Path(place, str(version)), False).close()
            return version
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            version += 1


def _append(spark: SparkSession, folder: str, row: dict) -> None:
    values = {"live": True, "version": _claimed(spark, folder, row["name"]), "claim": uuid.uuid4().hex, **row}
    df = spark.createDataFrame([tuple(values.get(f) for f in _FIELDS)], _SCHEMA)
    # A folder for each row: jobs that add to one folder at a time clear away each other's files.
    df.withColumn("saved_at", F.current_timestamp()).write.parquet(f"{folder.rstrip('/')}/row-{values['claim']}")


def save_model(
    spark: SparkSession, model: QuantileModel, folder: str, name: str | None = None
) -> str:
    """Add the model to the registry; a model of the same name is superseded."""
    name = name or model_name(model.target, model.label)
    _append(spark, folder, {
        "name": name, "target": model.target, "features": model.features,
        "medians": [model.medians.get(c) for c in model.features], "base": model.base,
        "alpha": model.alpha, "label": model.label, "mode": model.mode, "mae": model.mae,
        "mae_validation": model.mae_validation, "train_rows": model.rows.get("fit"),
        "validation_rows": model.rows.get("val"), "test_rows": model.rows.get("test"),
        "trees": [[tuple(asdict(n).values()) for n in t] for t in model.trees],
    })
    return name


def _current(spark: SparkSession, folder: str) -> DataFrame:
    try:
        rows = spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _SCHEMA)
    # Rows without a version are older than all that have one.
    newest = Window.partitionBy("name").orderBy(
        F.col("version").desc_nulls_last(), F.col("claim").desc(), F.col("saved_at").desc())
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1 AND live").drop("__n")


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Name and measures of each saved model, by name."""
    return _current(spark, folder).select(
        "name", "target", "mode", "label", "alpha", "mae", "mae_validation",
        F.size("features").alias("feature_count"), "train_rows", "validation_rows", "test_rows",
        "saved_at",
    ).orderBy("name")


def load_model(spark: SparkSession, folder: str, name: str) -> QuantileModel:
    row = _current(spark, folder).where(F.col("name") == name).first()
    if row is None or row["trees"] is None or not row["features"]:
        raise ValueError(f"No valid model {name!r} in {folder}")
    return QuantileModel(
        row["target"], list(row["features"]), dict(zip(row["features"], row["medians"])),
        row["base"], [[Node(*n) for n in t] for t in row["trees"]], row["alpha"], row["label"],
        row["mode"], row["mae"], row["mae_validation"],
        {"fit": row["train_rows"], "val": row["validation_rows"], "test": row["test_rows"]},
    )


def delete_model(spark: SparkSession, folder: str, name: str) -> None:
    """Take the model off the list. The registry only grows, so a reader never sees half a change."""
    if _current(spark, folder).where(F.col("name") == name).isEmpty():
        raise ValueError(f"No model {name!r} in {folder}")
    _append(spark, folder, {"name": name, "live": False})
