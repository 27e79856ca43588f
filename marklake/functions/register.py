"""SQL names for a session: ``normalize_text(t)`` and ``semantic_tokens(t)`` (native), ``partial_ratio(a, b)``
(Arrow) and the table function ``segment_document(text, question_ids)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from marklake.functions.fuzzy import partial_ratio_udf
from marklake.functions.lexicon import STOPWORDS
from marklake.functions.text import ACCENTED, PLAIN
from marklake.operators.ocr import segment_document
from marklake.shipping import ship


class Segments:
    """Rows of (question_id, segment, mode, confidence) of one document."""

    def eval(self, text: str, question_ids: list[str]) -> Iterator[tuple[str, str, str, float]]:
        found, mode, confidence = segment_document(text, [(q, "") for q in question_ids or []])
        for question, segment in found.items():
            yield question, segment, mode, float(confidence)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udf.register("partial_ratio", partial_ratio_udf)
    spark.udtf.register("segment_document", udtf(Segments, returnType="question_id string, segment string, mode string, confidence double"))
    plain = f"regexp_replace(translate(lower(trim(coalesce(t, ''))), '{ACCENTED}', '{PLAIN}'), '\\\\p{{Mn}}', '')"
    norm = f"trim(regexp_replace(regexp_replace({plain}, '[^a-z0-9\\\\s/._-]', ' '), '\\\\s+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN {norm}")
    stop = ", ".join(f"'{s}'" for s in STOPWORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION semantic_tokens(t STRING) RETURNS ARRAY<STRING> RETURN filter(split({norm}, ' '), w -> length(w) > 2 AND w NOT IN ({stop}))")
