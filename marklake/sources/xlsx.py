"""Workbooks as tables, read from their XML; one file is one task, many files are read in parallel."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.shipping import ship

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def parse(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Cells of a sheet as text, row by row; empty rows are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{NS}row"):
            cells: dict[int, str | None] = {}
            for place, c in enumerate(row.iter(f"{NS}c")):
                kind, v = c.get("t"), c.find(f"{NS}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                elif v is None or v.text is None:
                    value = None
                else:
                    value = shared[int(v.text)] if kind == "s" else v.text
                cells[_column(c.get("r")) if c.get("r") else place] = value
            if any(x is not None for x in cells.values()):
                rows.append([cells.get(i) for i in range(max(cells) + 1)])
    return rows


def rows(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """file, row_no, cells of all rows of all workbooks at ``path``."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, content in zip(batch["path"], batch["content"]):
                got = parse(content, sheet)
                yield pd.DataFrame({"file": [f] * len(got), "row_no": range(len(got)), "cells": got})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row_no long, cells array<string>")


def read(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A workbook's sheet with the first row as header; all columns are strings."""
    cells = rows(spark, path, sheet)
    head = cells.filter("row_no = 0").select("cells").first()
    names = [h if h else f"unnamed_{i}" for i, h in enumerate(head.cells if head else [])]
    return cells.filter("row_no > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
