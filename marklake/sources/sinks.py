"""Where results go: a table for each sheet of a report, rubrics as JSON, sessions by id."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions.text import normalize_py


def write_sheets(sheets: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each sheet under its own name; ``kind``: parquet, csv, json or orc."""
    for name, df in sheets.items():
        out = df.write.mode("overwrite")
        (out.option("header", True) if kind == "csv" else out).format(kind).save(f"{folder}/{name}")


def file_slug(name: str, fallback: str = "rubric") -> str:
    return re.sub(r"[^a-z0-9_-]+", "_", normalize_py(name)).strip("_")[:80] or fallback


def persist_rubric(documents: DataFrame, folder: str, name: str, overwrite: bool = False) -> str:
    """Write a rubric as JSON under a name made of its own; an existing one is kept unless told otherwise."""
    path = f"{folder}/{file_slug(name)}"
    documents.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return path


def save_session(rows: DataFrame, folder: str, session_id: str) -> None:
    """Rows of a session, in its partition; other sessions stay."""
    if not re.fullmatch(r"[0-9a-f]{12}", session_id):
        raise ValueError("a session id has twelve hexadecimal digits")
    rows.withColumn("session_id", F.lit(session_id)).write.mode("append").partitionBy("session_id").parquet(folder)


def read_session(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """The rows of a session; only its partition is read."""
    return spark.read.parquet(folder).filter(F.col("session_id") == session_id)
