"""Evidence between answers and targets, and the matcher's decision.

Evidence is computed once for each different (answer, variant) pair and holds no threshold; each consumer
decides with its own.  Native tests settle most pairs; only the rest go through the one Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marklake.functions import text
from marklake.functions.fuzzy import partial_ratio
from marklake.shipping import ship


def _pair_ratios(answer: pd.Series, variant: pd.Series, expansions: pd.Series) -> pd.DataFrame:
    rows = []
    for a, v, others in zip(answer, variant, expansions):
        pr = partial_ratio(a, v)
        rows.append((pr, max((pr if e == v else partial_ratio(a, e) for e in others), default=0.0)))
    return pd.DataFrame(rows, columns=["pr", "expansion_pr"], dtype="float64")


_ratios = F.pandas_udf(_pair_ratios, StructType([StructField("pr", DoubleType()), StructField("expansion_pr", DoubleType())]))


def answers_view(answers: DataFrame) -> DataFrame:
    """Answers with answer_norm, tokens, stems and profile."""
    a = answers.withColumn("answer_norm", text.normalize("answer"))
    a = a.withColumn("tokens", text.tokens("answer_norm"))
    return a.withColumn("stems", F.array_distinct(text.stems("tokens"))).withColumn("profile", text.length_profile("tokens"))


def evidence(pairs: DataFrame) -> DataFrame:
    """``pairs`` (answer_norm, stems, variant_norm, variant_stems, expansions, any keys) with the evidence."""
    ship(pairs.sparkSession)
    either = F.exists("expansions", lambda e: F.contains(F.col("answer_norm"), e) | F.contains(e, F.col("answer_norm")))
    e = (
        pairs.withColumn("contains", F.contains("answer_norm", "variant_norm"))
        .withColumn("within", F.contains("variant_norm", "answer_norm"))
        .withColumn("negated", text.negated("answer_norm", F.col("variant_stems")))
        .withColumn("overlap", text.overlap("stems", "variant_stems"))
        .withColumn("expansion_contains", either)
    )
    settled = (F.col("answer_norm") == "") | F.col("negated") | F.col("contains") | F.col("within")
    plain = e.filter(settled).withColumn("pr", F.lit(0.0)).withColumn("expansion_pr", F.lit(0.0))
    fuzzy = e.filter(~settled).withColumn("r", _ratios("answer_norm", "variant_norm", "expansions"))
    return plain.unionByName(fuzzy.withColumn("pr", F.col("r.pr")).withColumn("expansion_pr", F.col("r.expansion_pr")).drop("r"))


def decide(threshold: int, semantic: int, embedding: Column | None = None) -> Column:
    """struct(ok, score, method) of evidence under two thresholds; the first rule that holds wins."""
    emb = F.lit(0) if embedding is None else embedding
    floor = lambda c: F.floor(c).cast("int")

    def out(ok: bool, score: Column, method: str) -> Column:
        return F.struct(F.lit(ok).alias("ok"), score.cast("int").alias("score"), F.lit(method).alias("method"))

    enough = (emb >= 82) | (emb >= 78) & F.col("profile").isin("brief", "short")
    rest = F.greatest(floor("pr"), floor("expansion_pr"), F.col("overlap"), emb.cast("int"))
    return (
        F.when((F.col("answer_norm") == "") | (F.col("variant_norm") == ""), out(False, F.lit(0), "empty"))
        .when(F.col("negated"), out(False, F.lit(20), "negation"))
        .when(F.col("contains"), out(True, F.lit(100), "core"))
        .when(F.col("within"), out(True, F.lit(86), "core"))
        .when(F.col("pr") >= threshold, out(True, floor("pr"), "fuzzy"))
        .when(F.col("expansion_contains"), out(True, F.lit(88), "synonym"))
        .when(F.col("expansion_pr") >= semantic + 10, out(True, floor("expansion_pr"), "synonym"))
        .when(F.col("overlap") >= semantic, out(True, F.col("overlap"), "overlap"))
        .when(enough, out(True, emb, "embedding"))
        .otherwise(out(False, rest, "none"))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers, 0 where one has no length."""
    a, b = text.col(a), text.col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def embedding_score(cos: Column) -> Column:
    """A cosine as 0 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(F.lit(100.0) * (cos + F.lit(1.0)) / F.lit(2.0)).cast("int")))
