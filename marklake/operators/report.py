"""The reports of a graded batch: what each decision rests on, the teacher's rows, the technical rows, and the
tables that make up a workbook.

Everything reads answers that ``scoring.score_answers`` and ``diagnose.diagnosis`` have graded.  A sheet is a
DataFrame; ``sinks.write_sheets`` writes a dictionary of them.  The reports of one row are made from two aggregates,
by student and by question, which are folded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions import lexicon, text
from marklake.operators import diagnose, insight, scoring
from marklake.operators.insight import rounded

USE = "Read this report first: check the answers marked for review by hand, and revise questions or criteria where an item is listed as a problem."


def relations_found(norm: Column | str) -> Column:
    return text.labels(norm, lexicon.RELATIONS, lexicon.MORE_RELATIONS)


def traceability(graded: DataFrame) -> DataFrame:
    """A row for each decision, with the fourteen fields that explain it.  Without a student_name column it is empty."""
    name = F.col("student_name") if "student_name" in graded.columns else F.lit("")
    said = diagnose.feedback(F.col("error_type"), F.col("missing"), relations_found("answer_norm"), F.col("profile"))
    return graded.select(
        "student_id", name.alias("student_name"), "question_id", "status", rounded("score", 3).alias("score"), rounded("confidence", 2).alias("confidence"), "profile", "coverage",
        F.array_join(relations_found("answer_norm"), ", ").alias("relations"), "error_type", "severity", "basis", said.alias("feedback"), "answer",
    )


def judgements(graded: DataFrame) -> DataFrame:
    """The diagnosis of each answer: profile, coverage, counts, error, severity, missing concepts and the cognitive level."""
    level = scoring.cognitive_level(F.col("score") / F.greatest("max_score", F.lit(1e-9)), F.col("coverage"), F.col("relations"), F.col("profile"), F.col("confidence"))
    return graded.select(
        "student_id", "question_id", "profile", "coverage", "matched", "partial", "concepts", "relations", "contradictions", "error_type", "severity", level.alias("cognitive_level"),
        F.array_join("missing", ", ").alias("missing"), "basis",
    )


def _totals(graded: DataFrame) -> DataFrame:
    return insight.student_totals(graded, ["student_id"])


def _items(graded: DataFrame) -> DataFrame:
    return insight.item_statistics(graded, ["question_id"])


def overview(graded: DataFrame) -> DataFrame:
    """One row: students, questions, answers, counts by status, means, the three hardest and best questions, and the
    problem ones.  Questions are as few as a rubric has, so their names are listed."""
    totals, items = _totals(graded), _items(graded)
    counts = graded.agg(F.count("*").alias("answers"), *[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("accepted", "caution", "review")])
    people = totals.agg(F.count("*").alias("students"), F.avg("percent").alias("percent"))
    ordered = F.sort_array(F.collect_list(F.struct("avg_pct", "question_id")))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["question_id"]), ", ")
    listed = items.agg(
        F.count("*").alias("questions"), names(F.slice(ordered, 1, 3)).alias("hardest"), names(F.slice(F.reverse(ordered), 1, 3)).alias("best"), F.avg("avg_pct").alias("item_percent"),
        F.avg("review_pct").alias("item_review"), F.avg("avg_confidence").alias("item_confidence"),
        F.sort_array(F.collect_list(F.when(F.col("classification") == "needs review", F.col("question_id")))).alias("problems"),
    )
    out = counts.unionByName(people, allowMissingColumns=True).unionByName(listed, allowMissingColumns=True)  # a row each, folded into one
    out = out.agg(*[F.max(c).alias(c) for c in out.columns])
    for s in ("accepted", "caution", "review"):
        out = out.withColumn(f"{s}_pct", rounded(insight.percent_of(F.col(s), F.col("answers")), 1))
    return out


def _reading(rubric: str) -> Column:
    return F.format_string(
        f"{rubric.replace('%', '%%')}: %d students, %s performance, %.1f%% of the score on average, mean confidence %.2f, %.1f%% for manual review, %d items to revise.",
        "students", insight.level(F.col("item_percent")), rounded("item_percent", 1), rounded("item_confidence", 2), rounded("item_review", 1), F.size("problems").cast("long"),
    )


def teacher_report(graded: DataFrame, rubric: str, product: str = "Marklake") -> DataFrame:
    """place, section, indicator, value: the fourteen rows of the teacher's page."""
    pct = lambda c: F.concat(F.format_string("%.1f", c), F.lit("%"))
    problems = F.when(F.size("problems") > 0, F.array_join("problems", ", ")).otherwise("none")
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("no information"))
    rows = [
        ("product", "system", F.lit(product)), ("summary", "rubric", F.lit(rubric)), ("summary", "students", F.col("students").cast("string")), ("summary", "questions", F.col("questions").cast("string")),
        ("results", "mean percent", pct(rounded(F.coalesce("percent", F.lit(0.0)), 1))), ("results", "level", insight.level(F.coalesce("percent", F.lit(0.0)))),
        ("decisions", "accepted", pct("accepted_pct")), ("decisions", "with caution", pct("caution_pct")), ("decisions", "for review", pct("review_pct")),
        ("items", "hardest", none("hardest")), ("items", "best", none("best")), ("items", "problems", problems), ("reading", "summary", _reading(rubric)), ("advice", "use", F.lit(USE)),
    ]
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("section"), F.lit(b).alias("indicator"), c.alias("value")) for i, (a, b, c) in enumerate(rows)])
    return overview(graded).select(F.explode(cells).alias("r")).select("r.*")


def technical_summary(graded: DataFrame, rubric: str, rubric_file: str) -> DataFrame:
    """One row of eleven fields: what was graded, and how the decisions fell."""
    return overview(graded).select(
        F.lit(rubric).alias("rubric"), F.lit(rubric_file).alias("rubric_file"), "students", "questions", "answers", "accepted", "caution", "review", "accepted_pct", "caution_pct", "review_pct"
    )


def _row(df: DataFrame, values: dict) -> DataFrame:
    """The first row of ``df`` as one row of names and values that are known when the report is made."""
    return df.select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def sheets(graded: DataFrame, rubric: str, rubric_file: str, answers_file: str, questions: list[str], encoder: dict | None = None, version: str = "1", seconds: float | None = None) -> dict[str, DataFrame]:
    """The thirteen tables of a batch.  ``questions``: the rubric's, in order, each a column of the wide sheets;
    ``encoder``: mode, model and device of a sentence encoder, if one was used."""
    encoder = {"mode": "rules", "model": None, "device": None} | (encoder or {})
    items, seen = _items(graded), overview(graded)
    run = {"version": version, "answers_file": answers_file, "rubric": rubric, "students": F.col("students"), "questions": F.col("questions"), "answers": F.col("answers"), "seconds": F.lit(seconds).cast("double")}
    model = {f"encoder_{k}": F.lit(v).cast("string") for k, v in encoder.items()}
    totals = _totals(graded)
    wide = insight.pivot(graded, ["student_id"], "question_id", "score", questions).join(totals, "student_id")
    confidence = insight.pivot(graded, ["student_id"], "question_id", "confidence", questions).join(graded.groupBy("student_id").agg(rounded(F.avg("confidence"), 2).alias("mean_confidence")), "student_id")
    traces = traceability(graded)
    return {
        "teacher_report": teacher_report(graded, rubric), "scores": wide, "confidence": confidence,
        "feedback": traces.select("student_id", "student_name", "question_id", "score", "confidence", "status", "feedback", "answer"), "patterns": judgements(graded), "traceability": traces,
        "summary": technical_summary(graded, rubric, rubric_file), "robustness": _row(seen, run | model | {"criterion": "answers folded by question and text, evidence computed once for each pair, every decision traceable"}),
        "embeddings": _row(seen, {"version": version} | model), "validation": _row(seen, run | {k: F.col(k) for k in ("accepted_pct", "caution_pct", "review_pct")} | model),
        "items": items, "types": insight.type_rollup(insight.item_statistics(graded, ["question_id", "item_type"]), "item_type"),
        "interpretation": _row(seen, {"rubric": rubric, "reading": _reading(rubric), "problems": F.when(F.size("problems") > 0, F.array_join("problems", ", ")).otherwise("none")}),
    }


def session_sheets(graded: DataFrame, session: DataFrame, pages: DataFrame, questions: list[str], engine: str, version: str = "1") -> dict[str, DataFrame]:
    """The eight tables of photographed sheets: ``session`` (student_id, course, exam, date, raw_text, edited_text),
    ``pages`` (student_id, page and what the engines said of it)."""
    about = session.select("student_id", "course", "exam", "date")
    totals = _totals(graded)
    shares = graded.groupBy("student_id").agg(*[rounded(r, 1).alias(f"{s}_pct") for r, s in zip(insight.rates(F.count("*")), ("accepted", "caution", "review"))])
    traces = traceability(graded)
    levels = judgements(graded).select("student_id", "question_id", "cognitive_level")
    return {
        "summary": about.join(totals, "student_id").join(shares, "student_id").withColumn("engine", F.lit(engine)).withColumn("version", F.lit(version)),
        "scores": insight.pivot(graded, ["student_id"], "question_id", "score", questions).join(totals, "student_id"),
        "confidence": insight.pivot(graded, ["student_id"], "question_id", "confidence", questions),
        "feedback": traces.select("student_id", "student_name", "question_id", "answer", "score", "confidence", "status", "feedback").join(levels, ["student_id", "question_id"]),
        "traceability": traces, "judgements": judgements(graded), "pages": pages, "text": session.select("student_id", "edited_text", "raw_text"),
    }
