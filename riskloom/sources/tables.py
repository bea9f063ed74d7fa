"""Table readers and writers, and versioned snapshots."""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import fixed_values as fv
from riskloom.functions.scores import decimal_comma
from riskloom.session import cut_lineage

_FORMATS = {".csv": "csv", ".parquet": "parquet"}


def format_of(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in _FORMATS:
        raise ValueError(f"unsupported table format {extension!r}; use csv or parquet")
    return _FORMATS[extension]


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null, once, at the source."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Read csv or parquet by extension. Csv without a schema is inferred (a second pass); ``multi_line`` as in ``read_csv``."""
    if format_of(path) == "parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return missing_as_null(reader.parquet(path))
    return missing_as_null(read_csv(spark, path, schema, multi_line=multi_line))


def csv_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 when the whole file decodes as utf-8, else the next encoding, which takes any byte."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return fv.TEXT_ENCODINGS[1] if broken.count() else fv.TEXT_ENCODINGS[0]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",",
    encoding: str | None = None, multi_line: bool = True,
) -> DataFrame:
    """Csv with header; lines with a wrong number of fields are skipped, ``bad_csv_lines`` shows them.

    Quoted cells may hold doubled quotes and, with ``multi_line``, line breaks. Files with such breaks can't be split, so
    each file is then read by one task. ``multi_line=False`` states that no cell holds a line break: every line is a record
    and large files are split among tasks.
    """
    reader = _csv_reader(spark, path, sep, encoding, multi_line).option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def _csv_reader(spark: SparkSession, path: str, sep: str, encoding: str | None, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding or csv_encoding(spark, path))
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )


def bad_csv_lines(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """``line``: the raw records that ``read_csv`` with this schema skips."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    reader = _csv_reader(spark, path, sep, encoding, multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    # Written with all columns, as a reader that is asked for the raw record alone parses nothing.
    return cut_lineage(reader.schema(wide).csv(path).filter("_bad IS NOT NULL")).select(F.col("_bad").alias("line"))


def read_decimal_comma_csv(
    spark: SparkSession, path: str, numeric: Sequence[str], schema: T.StructType | None = None,
    sep: str = ";", encoding: str = "iso-8859-1",
) -> DataFrame:
    """Semicolon-separated text where numbers carry a decimal comma."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    raw = (reader.schema(schema) if schema else reader).csv(path)
    return raw.withColumns({c: decimal_comma(c) for c in numeric})


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    fmt = fmt or format_of(path)
    if fmt not in _FORMATS.values():
        raise ValueError(f"unsupported table format {fmt!r}; use csv or parquet")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_snapshot(
    df: DataFrame, root: str, prefix: str, at: datetime | None = None
) -> str:
    """Write one dated version under ``root/prefix=…/snapshot_ts=…``; returns its timestamp text."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    df.write.mode("errorifexists").parquet(f"{root}/prefix={prefix}/snapshot_ts={stamp}")
    return stamp


def read_latest_snapshot(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Newest version of a prefix; both filters prune partitions before any file is opened."""
    versions = spark.read.parquet(root).filter(F.col("prefix") == prefix)
    dated = F.col("snapshot_ts").rlike(f"^{fv.SNAPSHOT_PATTERN}$")
    newest = versions.filter(dated).agg(F.max("snapshot_ts")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no snapshot of {prefix!r} under {root}")
    return versions.filter(F.col("snapshot_ts") == newest).drop("prefix", "snapshot_ts")


def newest_version(versions: DataFrame, prefix: str = "prefix", stamp: str = "snapshot_ts") -> DataFrame:
    """Rows of the newest version of every prefix, given a version column."""
    newest = versions.groupBy(prefix).agg(F.max(stamp).alias(stamp))
    return versions.join(newest, [prefix, stamp], "left_semi")
