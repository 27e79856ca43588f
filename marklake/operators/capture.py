"""Guards, gates and derived columns of the photo and answer flows, and the hooks for models that are not part
of this package: text recognition engines and sentence encoders are callables given by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.shipping import ship

MAX_BYTES = 20 * 1024 * 1024
KINDS = ["jpg", "jpeg", "png", "webp", "bmp"]


def guard(files: DataFrame, kinds: list[str] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """``files`` (path, length, as Spark's binaryFile source gives them) with the reason why each is rejected, or
    null.  The content is not read for it."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^.\\/]+)$", 1))
    reason = F.when(~suffix.isin(kinds or KINDS), "kind").when(F.col("length") <= 0, "empty").when(F.col("length") > most, "too large")
    return files.withColumn("rejected", reason)


def edited_answers(fallback: DataFrame, edited: DataFrame, key: list[str]) -> DataFrame:
    """Answers of segments, with what a person wrote in their place: ``fallback`` (key, segment), ``edited``
    (key, answer)."""
    e = edited.select(*key, F.nullif(F.trim("answer"), F.lit("")).alias("__edited"))
    return fallback.join(e, key, "left").select(*key, F.coalesce("__edited", "segment").alias("answer"), F.col("__edited").isNotNull().alias("direct"))


def student_gate(answers: DataFrame, student: str) -> DataFrame:
    """Students and whether they answered anything; the others are an error row, not a zero."""
    some = F.max((F.trim(F.coalesce("answer", F.lit(""))) != "").cast("int")) == 1
    return answers.groupBy(student).agg(some.alias("answered"), F.when(~some, "no answers").alias("error"))


def class_average(results: DataFrame) -> DataFrame:
    """Mean percentage of the students without an error."""
    fine = F.col("error").isNull()
    return results.agg(F.round(F.avg(F.when(fine, F.col("percent"))) + F.lit(1e-9), 2).alias("average"), F.sum(fine.cast("int")).alias("valid"), F.sum((~fine).cast("int")).alias("failed"))


def derived(pages: DataFrame) -> DataFrame:
    """Pages (x, y, w, h) with centre, area and aspect_ratio (0 without height)."""
    return pages.select("*", (F.col("x") + F.col("w") / 2).alias("center_x"), (F.col("y") + F.col("h") / 2).alias("center_y"), (F.col("w") * F.col("h")).alias("area"), F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0).alias("aspect_ratio"))


def requires_confirmation(complete: Column, warnings: Column, confirmed: Column) -> Column:
    return ~complete | (F.size(warnings) > 0) | ~confirmed


def ready_for_ocr(success: Column, acceptable: Column, pages: Column, incomplete_groups: Column) -> Column:
    return success & acceptable & (pages > 0) & (incomplete_groups == 0)


def warnings(lists: list[Column]) -> Column:
    """The union of lists of warnings, in order, each once."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def page_label(student: Column, page: Column, complete: Column) -> Column:
    return F.concat(F.lit("student "), student.cast("string"), F.lit(", page "), page.cast("string"), F.when(complete, "").otherwise(" (incomplete)"))


def recognize(files: DataFrame, engine: str, read: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    """path, engine, text, confidence, message of each file (path, content) through a recognition engine; an
    engine's failure is a message and no text, never a failed job."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found, confidence, message = *read(bytes(content)), ""
                except Exception as e:  # engines are foreign code
                    found, confidence, message = "", 0.0, f"{type(e).__name__}: {e}"[:200]
                rows.append((path, engine, found or "", float(confidence), message))
            yield pd.DataFrame(rows, columns=["path", "engine", "text", "confidence", "message"])

    return files.select("path", "content").mapInPandas(run, "path string, engine string, text string, confidence double, message string")


def encode(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], size: int = 32) -> DataFrame:
    """norm, vector of each different normalized text (norm), ``size`` at a time through a sentence encoder."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_texts = batch["norm"].tolist()
            for k in range(0, len(all_texts), size):
                part = all_texts[k : k + size]
                yield pd.DataFrame({"norm": part, "vector": [[float(x) for x in v] for v in encoder(part)]})

    return texts.select("norm").filter("norm <> ''").distinct().mapInPandas(run, "norm string, vector array<float>")
