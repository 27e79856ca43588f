"""Statistics queries over a gradebook made of orders and lineitem: a customer is a student, a part an item,
1.6 times the quantity (50 at most) the score out of 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.operators import insight


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gradebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    confidence = F.lit(1.0) - F.lit(3.5) * F.col("l_discount") - F.when(F.col("l_tax") >= 0.07, 0.3).otherwise(0.0)
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("item_type"),
        F.least(F.lit(50.0), F.lit(1.6) * F.col("l_quantity")).alias("score"), F.lit(50.0).alias("max_score"), confidence.alias("confidence"), insight.status(confidence).alias("status"),
    )


BOOK = """g AS (
  SELECT o_custkey AS student_id, l_partkey AS item_id, l_linenumber AS line, l_returnflag AS item_type,
    least(50.0::DOUBLE, 1.6::DOUBLE * l_quantity) AS score, 50.0::DOUBLE AS max_score,
    1.0::DOUBLE - 3.5::DOUBLE * l_discount - CASE WHEN l_tax >= 0.07 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), b AS (
  SELECT *, CASE WHEN confidence >= 0.82 THEN 'accepted' WHEN confidence < 0.48 THEN 'review' ELSE 'caution' END AS status FROM g
)"""


def _rate(s: str) -> str:
    return f"(CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)) * 100.0::DOUBLE"


def level_sql(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'unknown' WHEN {p} >= 80 THEN 'high' WHEN {p} >= 60 THEN 'medium' ELSE 'low' END"


def _class_sql() -> str:
    return "CASE WHEN p >= 80 AND r < 20 THEN 'high performance' WHEN r >= 35 OR a <= 50 OR c < 0.60 THEN 'needs review' WHEN k >= 30 THEN 'intermediate' ELSE 'adequate' END"


def items_sql(by: str) -> str:
    return f"WITH {BOOK}, {items_body(by)}"


def items_body(by: str) -> str:
    """Items of the graded rows ``b``."""
    return f"""s_ AS (
  SELECT {by}, count(*) AS answers, avg(score) AS s, avg(confidence) AS c, avg(score) / max(max_score) * 100.0::DOUBLE AS p,
    {_rate("accepted")} AS a, {_rate("caution")} AS k, {_rate("review")} AS r
  FROM b GROUP BY {by}
), i AS (
  SELECT *, {_class_sql()} AS classification FROM s_
), items AS (
  SELECT {by}, answers, round(s + 1e-9::DOUBLE, 3) AS avg_score, round(p + 1e-9::DOUBLE, 2) AS avg_pct, {level_sql("p")} AS item_level, round(c + 1e-9::DOUBLE, 3) AS avg_confidence,
    round(a + 1e-9::DOUBLE, 2) AS accepted_pct, round(k + 1e-9::DOUBLE, 2) AS caution_pct, round(r + 1e-9::DOUBLE, 2) AS review_pct, classification,
    CASE WHEN lower(classification) LIKE '%review%' THEN 'revise the question, the rubric or the criteria'
         WHEN r >= 30 THEN 'check a sample of answers by hand' WHEN p < 60 THEN 'hard for the group: reinforce the content'
         WHEN c < 0.70 THEN 'give more explicit criteria or examples' ELSE 'stable' END AS suggestion
  FROM i
)"""


TOTALS = """totals AS (
  SELECT student_id, round(sum(score) + 1e-9::DOUBLE, 2) AS total, round(sum(score) / sum(max_score) * 100.0::DOUBLE + 1e-9::DOUBLE, 2) AS percent FROM b GROUP BY student_id
)"""
LINES = list(range(1, 8))


def _items(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return insight.item_statistics(gradebook(spark, d), ["item_id", *more])


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return insight.student_totals(gradebook(spark, d), ["student_id"])


def interpretation_kpis(spark: SparkSession, d: str) -> DataFrame:
    book = gradebook(spark, d)
    return insight.interpretation(insight.item_statistics(book, ["item_id"]), book, "Gradebook")


def level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d).groupBy("level").agg(F.count("*").alias("students"))


def missing_items_anti(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    return part.join(gradebook(spark, d).filter("status = 'review'").select("item_id"), "item_id", "left_anti")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The report as section, indicator and value, by union of aggregates of one row each; a value that has nothing to rest on is null."""
    book = gradebook(spark, d)
    totals, items = insight.student_totals(book, ["student_id"]), insight.item_statistics(book, ["item_id"])
    mean = F.avg("percent")
    names = F.when(F.count("item_id") > 0, F.array_join(F.array_sort(F.collect_list("item_id")), ", "))

    def row(df: DataFrame, section: str, name: str, value) -> DataFrame:
        return df.agg(value.cast("string").alias("value")).select(F.lit(section).alias("section"), F.lit(name).alias("indicator"), "value")

    out = row(totals, "summary", "students", F.count("*"))
    for part in (
        row(items, "summary", "items", F.count("*")), row(totals, "results", "level", insight.level(mean)), row(totals, "results", "mean percent", F.concat(insight.figure(mean, 1), F.lit("%"))),
        row(items, "items", "to revise", F.sum(F.when(F.col("classification") == "needs review", 1).otherwise(0))),
        row(insight.extremes(items, "item_id"), "items", "hardest", names),
        row(insight.extremes(items, "item_id", hardest=False), "items", "best", names),
    ):
        out = out.unionByName(part)
    return out


QUERIES = {
    "student_totals": _totals,
    "level_histogram": level_histogram,
    "item_statistics": _items,
    "type_rollup": lambda s, d: insight.type_rollup(_items(s, d, "item_type"), "item_type"),
    "global_rates": lambda s, d: insight.global_rates(gradebook(s, d)),
    "interpretation_kpis": interpretation_kpis,
    "hardest_items": lambda s, d: insight.extremes(_items(s, d), "item_id"),
    "best_items": lambda s, d: insight.extremes(_items(s, d), "item_id", hardest=False),
    "score_pivot": lambda s, d: insight.pivot(gradebook(s, d), ["student_id"], "line", "score", LINES),
    "confidence_pivot": lambda s, d: insight.pivot(gradebook(s, d), ["student_id"], "line", "confidence", LINES),
    "problem_items": lambda s, d: insight.problem_items(_items(s, d), "item_id"),
    "missing_items_anti": missing_items_anti,
    "traceability": lambda s, d: insight.traceability(gradebook(s, d), F.concat_ws(" | ", F.concat(F.lit("status "), "status"), F.when(F.col("score") == F.col("max_score"), "full marks"))),
    "report_rows": report_rows,
}


def _pivot_sql(value: str) -> str:
    cells = ", ".join(f"round(sum(CASE WHEN line = {i} THEN {value} END) + 1e-9::DOUBLE, 2) AS q{i}_{value}" for i in LINES)
    return f"WITH {BOOK} SELECT student_id, {cells} FROM b GROUP BY student_id"


_KPI = f"""{items_sql("item_id")}, t AS (
  SELECT avg(avg_pct) AS p, avg(review_pct) AS r, avg(avg_confidence) AS c, CAST(sum(CASE WHEN classification = 'needs review' THEN 1 ELSE 0 END) AS BIGINT) AS problems,
    (SELECT count(DISTINCT student_id) FROM b) AS students FROM items
)"""
ORACLE_SQL = {
    "student_totals": f"WITH {BOOK}, {TOTALS} SELECT *, {level_sql('percent')} AS level FROM totals",
    "level_histogram": f"WITH {BOOK}, {TOTALS} SELECT {level_sql('percent')} AS level, count(*) AS students FROM totals GROUP BY 1",
    "item_statistics": items_sql("item_id") + " SELECT * FROM items",
    "type_rollup": items_sql("item_id, item_type")
    + " SELECT item_type, count(*) AS items, round(avg(avg_pct) + 1e-9::DOUBLE, 2) AS avg_pct, round(avg(avg_confidence) + 1e-9::DOUBLE, 2) AS avg_confidence, round(avg(review_pct) + 1e-9::DOUBLE, 2) AS review_pct, round(avg(accepted_pct) + 1e-9::DOUBLE, 2) AS accepted_pct FROM items GROUP BY item_type",
    "global_rates": f"WITH {BOOK} SELECT count(*) AS answers, " + ", ".join(f"round({_rate(s)} + 1e-9::DOUBLE, 1) AS {s}_pct" for s in ("accepted", "caution", "review")) + " FROM b",
    "interpretation_kpis": _KPI
    + f""" SELECT students, round(p + 1e-9::DOUBLE, 1) AS avg_pct, {level_sql("p")} AS level, round(c + 1e-9::DOUBLE, 2) AS avg_confidence, round(r + 1e-9::DOUBLE, 1) AS review_pct, problems,
  format('Gradebook: {{}} students, {{}} performance, {{:.1f}}% of the score on average, mean confidence {{:.2f}}, {{:.1f}}% for manual review, {{}} items to revise.',
    students, {level_sql("p")}, round(p + 1e-9::DOUBLE, 1), round(c + 1e-9::DOUBLE, 2), round(r + 1e-9::DOUBLE, 1), problems) AS summary FROM t""",
    "hardest_items": items_sql("item_id") + " SELECT item_id, avg_pct FROM items ORDER BY avg_pct, item_id LIMIT 3",
    "best_items": items_sql("item_id") + " SELECT item_id, avg_pct FROM items ORDER BY avg_pct DESC, item_id DESC LIMIT 3",
    "score_pivot": _pivot_sql("score"),
    "confidence_pivot": _pivot_sql("confidence"),
    "problem_items": items_sql("item_id") + " SELECT item_id FROM items WHERE classification = 'needs review'",
    "missing_items_anti": f"WITH {BOOK} SELECT p_partkey AS item_id, p_type FROM part WHERE NOT EXISTS (SELECT 1 FROM b WHERE item_id = p_partkey AND status = 'review')",
    "traceability": f"""WITH {BOOK} SELECT student_id, item_id, status, round(score + 1e-9::DOUBLE, 2) AS score, round(confidence + 1e-9::DOUBLE, 2) AS confidence,
  format('confidence={{:.2f}}; status={{}}', round(confidence + 1e-9::DOUBLE, 2), status) AS basis,
  'status ' || status || CASE WHEN score = max_score THEN ' | full marks' ELSE '' END AS feedback FROM b""",
    "report_rows": items_sql("item_id")
    + f""", {TOTALS}
SELECT 'summary' AS section, 'students' AS indicator, CAST(count(*) AS VARCHAR) AS value FROM totals
UNION ALL SELECT 'summary', 'items', CAST(count(*) AS VARCHAR) FROM items
UNION ALL SELECT 'results', 'level', {level_sql("avg(percent)")} FROM totals
UNION ALL SELECT 'results', 'mean percent', format('{{:.1f}}%', round(avg(percent) + 1e-9::DOUBLE, 1)) FROM totals
UNION ALL SELECT 'items', 'to revise', CAST(CAST(sum(CASE WHEN classification = 'needs review' THEN 1 ELSE 0 END) AS BIGINT) AS VARCHAR) FROM items
UNION ALL SELECT 'items', 'hardest', string_agg(CAST(item_id AS VARCHAR), ', ' ORDER BY item_id) FROM (SELECT item_id FROM items ORDER BY avg_pct, item_id LIMIT 3)
UNION ALL SELECT 'items', 'best', string_agg(CAST(item_id AS VARCHAR), ', ' ORDER BY item_id) FROM (SELECT item_id FROM items ORDER BY avg_pct DESC, item_id DESC LIMIT 3)""",
}
