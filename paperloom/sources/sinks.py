"""Sinks: exports, appends and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Semicolons, CRLF, renamed columns, empty cells for nulls, and a byte order mark before the header of each file.

    The mark is part of the first header name, as Spark writes none itself.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(("﻿" if i == 0 else "") + n) for i, (c, n) in enumerate(columns.items())]
    df.select(*named).write.mode("overwrite").option("header", True).option("sep", ";").option("lineSep", "\r\n").option("emptyValue", "").option("quoteAll", False).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def truth_samples(df: DataFrame, evidence: list[str], labels: list[str], width: int = 8000) -> DataFrame:
    """Training rows: the evidence fields that aren't blank, one per line and cut, with their labels; rows without labels are dropped."""
    text = F.substring(F.concat_ws("\n", *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in evidence]), 1, width)
    return df.select(text.alias("text"), *labels).where(" or ".join(f"trim({c}) <> ''" for c in labels))


def tasks_json(df: DataFrame, wanted: Column, data: list[str]) -> DataFrame:
    """One JSON task per row that is wanted."""
    return df.where(wanted).select(F.to_json(F.struct(F.struct(*data).alias("data"))).alias("task"))
