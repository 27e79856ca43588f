"""Totals, item statistics, roll-ups and reports over scored answers.

Scored answers have student_id, item_id, score, max_score, confidence and status (accepted, caution or
review).  Every aggregate is a hash aggregation with map-side combining; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCEPT, REVIEW = 0.82, 0.48
GUARD = 1e-9


def rounded(c: Column | str, digits: int) -> Column:
    """Half up.  The guard makes ties go the same way whatever the order in which doubles were added."""
    return F.round(guarded(F.col(c) if isinstance(c, str) else c), digits)


def figure(c: Column | str, digits: int) -> Column:
    """Rounded, as text with so many digits: null, nan and inf as the SQL's ``format`` has them."""
    x = rounded(c, digits)
    return F.when(x.isNotNull(), F.replace(F.lower(F.format_string(f"%.{digits}f", x)), F.lit("infinity"), F.lit("inf")))


def guarded(mean: Column) -> Column:
    """A mean as it is held against a bound: one that lies on the bound is on it, however its sum was rounded."""
    return mean + F.lit(GUARD)


def status(confidence: Column) -> Column:
    return F.when(confidence >= ACCEPT, "accepted").when(confidence < REVIEW, "review").otherwise("caution")


def level(percent: Column) -> Column:
    """Performance level of a percentage, which may be any type."""
    p = guarded(percent.try_cast("double"))
    return F.when(p.isNull(), "unknown").when(p >= 80, "high").when(p >= 60, "medium").otherwise("low")


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def rates(total: Column) -> list[Column]:
    return [(F.sum(F.when(F.col("status") == s, 1).otherwise(0)) / total * F.lit(100.0)).alias(f"{s}_pct") for s in ("accepted", "caution", "review")]


def student_totals(scored: DataFrame, by: list[str], total_score: float | None = None) -> DataFrame:
    """Total, percentage and level of each student row; the declared total of the rubric wins over the sum."""
    whole = F.lit(float(total_score)) if total_score else F.sum("max_score")
    t = scored.groupBy(*by).agg(F.sum("score").alias("total"), whole.alias("possible"))
    t = t.withColumn("percent", rounded(percent_of(F.col("total"), F.when(F.col("possible") > 0, F.col("possible")).otherwise(1.0)), 2))
    return t.select(*by, rounded("total", 2).alias("total"), "percent", level(F.col("percent")).alias("level"))


def classify(avg_pct: Column, accepted: Column, caution: Column, review: Column, confidence: Column) -> Column:
    """The rates are quotients of counts, which no order changes; the two means are sums of doubles."""
    return (
        F.when((guarded(avg_pct) >= 80) & (review < 20), "high performance")
        .when((review >= 35) | (accepted <= 50) | (guarded(confidence) < 0.60), "needs review")
        .when(caution >= 30, "intermediate")
        .otherwise("adequate")
    )


def suggestion(classification: Column, review: Column, avg_pct: Column, confidence: Column) -> Column:
    return (
        F.when(F.contains(F.lower(classification), F.lit("review")), "revise the question, the rubric or the criteria")
        .when(review >= 30, "check a sample of answers by hand")
        .when(guarded(avg_pct) < 60, "hard for the group: reinforce the content")
        .when(guarded(confidence) < 0.70, "give more explicit criteria or examples")
        .otherwise("stable")
    )


def item_statistics(scored: DataFrame, by: list[str]) -> DataFrame:
    """Averages, rates, class and suggestion of each item.  Rules see unrounded values, with the guard of ``rounded``."""
    n = F.count("*")
    t = scored.groupBy(*by).agg(n.alias("answers"), F.avg("score").alias("s"), F.max("max_score").alias("m"), F.avg("confidence").alias("c"), *rates(n))
    t = t.withColumn("p", percent_of(F.col("s"), F.col("m")))
    rule = classify(F.col("p"), F.col("accepted_pct"), F.col("caution_pct"), F.col("review_pct"), F.col("c"))
    t = t.withColumn("classification", rule)
    return t.select(
        *by, "answers", rounded("s", 3).alias("avg_score"), rounded("p", 2).alias("avg_pct"), level(F.col("p")).alias("item_level"), rounded("c", 3).alias("avg_confidence"),
        *[rounded(f"{s}_pct", 2).alias(f"{s}_pct") for s in ("accepted", "caution", "review")],
        "classification", suggestion(F.col("classification"), F.col("review_pct"), F.col("p"), F.col("c")).alias("suggestion"),
    )


def type_rollup(items: DataFrame, kind: str) -> DataFrame:
    """Means of the items' rounded values for each type; a null type is a type."""
    return items.groupBy(kind).agg(
        F.count("*").alias("items"), rounded(F.avg("avg_pct"), 2).alias("avg_pct"), rounded(F.avg("avg_confidence"), 2).alias("avg_confidence"),
        rounded(F.avg("review_pct"), 2).alias("review_pct"), rounded(F.avg("accepted_pct"), 2).alias("accepted_pct"),
    )


def global_rates(scored: DataFrame) -> DataFrame:
    n = F.count("*")
    return scored.agg(n.alias("answers"), *[rounded(r, 1).alias(f"{s}_pct") for r, s in zip(rates(n), ("accepted", "caution", "review"))])


def interpretation(items: DataFrame, students: DataFrame, rubric: str) -> DataFrame:
    """One row: the means over items, the level, the problem items and a sentence, null where it lacks a figure."""
    means = items.agg(
        F.avg("avg_pct").alias("p"), F.avg("review_pct").alias("r"), F.avg("avg_confidence").alias("c"),
        F.sum(F.when(F.col("classification") == "needs review", 1).otherwise(0)).alias("problems"),
    )
    count = students.agg(F.countDistinct("student_id").alias("students"))
    both = means.unionByName(count, allowMissingColumns=True)  # a row each, folded into one
    t = both.agg(*[F.max(c).alias(c) for c in ("p", "r", "c", "problems", "students")])
    text = F.concat(
        F.lit(f"{rubric}: "), "students", F.lit(" students, "), level(F.col("p")), F.lit(" performance, "), figure("p", 1), F.lit("% of the score on average, mean confidence "),
        figure("c", 2), F.lit(", "), figure("r", 1), F.lit("% for manual review, "), "problems", F.lit(" items to revise."),
    )
    return t.select("students", rounded("p", 1).alias("avg_pct"), level(F.col("p")).alias("level"), rounded("c", 2).alias("avg_confidence"), rounded("r", 1).alias("review_pct"), "problems", text.alias("summary"))


def extremes(items: DataFrame, key: str, n: int = 3, hardest: bool = True) -> DataFrame:
    """The ``n`` items of the lowest or highest average, ties by key."""
    order = [F.col("avg_pct").asc(), F.col(key).asc()] if hardest else [F.col("avg_pct").desc(), F.col(key).desc()]
    return items.orderBy(*order).limit(n).select(key, "avg_pct")


def pivot(scored: DataFrame, by: list[str], item: str, value: str, items: list, digits: int = 2) -> DataFrame:
    """A column for each item; its names are known, so no job runs to find them."""
    t = scored.groupBy(*by).pivot(item, items).agg(rounded(F.sum(value), digits))
    return t.select(*by, *[F.col(f"`{i}`").alias(f"q{i}_{value}") for i in items])


def traceability(scored: DataFrame, feedback: Column) -> DataFrame:
    """One row for each decision, with what it rests on."""
    basis = F.concat_ws("; ", F.format_string("confidence=%.2f", rounded("confidence", 2)), F.concat(F.lit("status="), "status"))
    return scored.select("student_id", "item_id", "status", rounded("score", 2).alias("score"), rounded("confidence", 2).alias("confidence"), basis.alias("basis"), feedback.alias("feedback"))


def problem_items(items: DataFrame, key: str) -> DataFrame:
    return items.filter(F.col("classification") == "needs review").select(key)


def rank_students(totals: DataFrame) -> DataFrame:
    """Quartile and rank by percentage.  The ranks are global, so totals should be per class or per item type."""
    return totals.withColumn("rank", F.rank().over(Window.partitionBy("level").orderBy(F.col("percent").desc())))
