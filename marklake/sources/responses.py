"""Answer tables: one row for each student, one column for each question, under many possible headers.

Finding columns is planning on the driver over ``df.columns``; no job runs for it.  Where several headers
fit, the first in the order of preference is taken.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.functions import lexicon, text


def aliases(question_id: str) -> list[str]:
    """Canonical headers under which a question may stand, in order of preference."""
    names = [text.header_py(question_id)]
    if m := re.search(r"\d+", str(question_id)):
        names += [f"{p}{m[0]}" for p in ("p", "q", "pregunta", "pregunta_", "item", "item_", "i")]
    return list(dict.fromkeys(names))


def find(columns: list[str], names: list[str]) -> str | None:
    """The column whose canonical header is the first of ``names`` to occur."""
    by_header = {text.header_py(c): c for c in columns}
    return next((by_header[n] for n in names if n in by_header), None)


def issues(df: DataFrame, question_ids: list[str], row_limit: int | None = None) -> list[str]:
    """What keeps a table from being graded.  A limit of rows is a policy of the caller, not of the engine."""
    out = []
    if df.isEmpty():
        out.append("the table is empty")
    if len(df.columns) < 3:
        out.append("fewer than three columns")
    unnamed = [c for c in df.columns if not c.strip() or c.lower().startswith(("unnamed", "_c"))]
    if len(unnamed) >= max(2, len(df.columns) // 2):
        out.append("many columns without a name")
    if row_limit is not None and df.limit(row_limit + 1).count() > row_limit:
        out.append(f"more than {row_limit} rows")
    if not find(df.columns, lexicon.ID_HEADERS):
        out.append("no column for the student's id")
    if not find(df.columns, lexicon.NAME_HEADERS):
        out.append("no column for the student's name")
    out += [f"no column for question {q}" for q in question_ids if not find(df.columns, aliases(q))]
    return out


def preview(df: DataFrame, question_ids: list[str]) -> list[tuple[str, str | None, bool]]:
    """question, the column found for it, and whether one was."""
    return [(q, c, c is not None) for q in question_ids for c in [find(df.columns, aliases(q))]]


def unpivot(df: DataFrame, question_ids: list[str]) -> DataFrame:
    """student_id, student_name, row_no, question_id, source_column, answer: a row for each student row and
    question whose column is there."""
    sid, name = find(df.columns, lexicon.ID_HEADERS), find(df.columns, lexicon.NAME_HEADERS)
    found = [(q, c) for q in question_ids if (c := find(df.columns, aliases(q)))]
    keyed = df.select(
        F.monotonically_increasing_id().alias("row_no"), (F.col(f"`{sid}`") if sid else F.lit("")).cast("string").alias("student_id"), (F.col(f"`{name}`") if name else F.lit("")).cast("string").alias("student_name"),
        F.array(*[F.struct(F.lit(q).alias("question_id"), F.lit(c).alias("source_column"), F.col(f"`{c}`").cast("string").alias("answer")) for q, c in found]).alias("cells"),
    )
    return keyed.select("student_id", "student_name", "row_no", F.explode("cells").alias("x")).select("student_id", "student_name", "row_no", "x.*")
