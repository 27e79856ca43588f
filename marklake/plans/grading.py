"""Queries that grade: parts answer the question of their size, whose rubric has the first three parts of that size
as criteria.  The whole path runs: targets, evidence, the matcher's decision, the open scorer, diagnosis, reports.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.functions import lexicon, text
from marklake.operators import diagnose, match, report, scoring
from marklake.operators.insight import rounded
from marklake.plans import gradebook, texts
from marklake.plans.texts import in_sql, norm_sql, overlap_sql, profile_sql, stems_sql, tokens_sql
from marklake.sources import rubric

TOP = 10.0


def said() -> Column:
    return F.concat_ws(" ", "p_name", "p_type")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("string").alias("question_id"), said().alias("said"))


def answers(s: SparkSession, d: str) -> DataFrame:
    a = _parts(s, d)
    return match.answers_view(a.select("p_partkey", "question_id", F.col("said").alias("answer")))


def targets(s: SparkSession, d: str) -> DataFrame:
    """Three of each question."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("p_partkey"))
    t = _parts(s, d).withColumn("place", place).filter("place <= 3")
    t = t.select(F.col("p_partkey").alias("item_id"), "question_id", (F.col("place") - 1).alias("place"), F.col("said").alias("concept"), text.normalize("said").alias("variant_norm"))
    return t.withColumn("variant_stems", F.array_distinct(text.stems(text.tokens("variant_norm"))))


def pairs(s: SparkSession, d: str) -> DataFrame:
    return answers(s, d).drop("answer").join(targets(s, d), "question_id")


def token_overlap_match(s, d):
    return pairs(s, d).select("p_partkey", "item_id", text.overlap("stems", "variant_stems").alias("overlap"))


def overlap_best_target(s, d):
    """The best target of each answer, the first on ties."""
    p = token_overlap_match(s, d).groupBy("p_partkey").agg(F.max(F.struct("overlap", (-F.col("item_id")).alias("i"))).alias("b"))
    return p.select("p_partkey", (-F.col("b.i")).alias("item_id"), F.col("b.overlap").alias("overlap"))


def fuzzy_partial_ratio(s, d):
    """Arrow UDF over the pairs that containment does not settle."""
    p = pairs(s, d).withColumn("expansions", F.array("variant_norm"))
    return match.evidence(p).select("p_partkey", "item_id", "contains", "negated", "overlap", rounded("pr", 2).alias("partial_ratio"))


def semantic_match_full(s, d):
    p = pairs(s, d).withColumn("expansions", F.array("variant_norm"))
    return match.evidence(p).withColumn("d", match.decide(68, 62)).select("p_partkey", "item_id", "d.ok", "d.score", "d.method")


def _rubric(s: SparkSession, d: str) -> DataFrame:
    empty = F.expr("array()").cast("array<string>")
    t = targets(s, d).groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "concept"))).alias("c"))
    return t.select(
        F.lit(0).alias("q_pos"), "id", F.lit("criteria").alias("item_type"), F.lit(TOP).alias("max_score"), F.lit("").alias("prompt"), empty.alias("accepted_answers"), empty.alias("accepted_concepts"),
        F.struct(F.lit(None).cast("int").alias("required_number_of_items")).alias("constraints"),
        F.transform("c", lambda x: F.struct(x["concept"].alias("concept"), F.lit(1.0).alias("weight"), empty.alias("semantic_variants"), empty.alias("accepted_values"))).alias("criteria"),
        F.lit(None).cast(f"array<{rubric.PAIR}>").alias("pairs"), F.lit(None).cast("string").alias("indispensable_element"), empty.alias("equivalent_examples"), F.lit(None).cast("string").alias("evaluation_observations"),
    )


def graded(s: SparkSession, d: str) -> DataFrame:
    """A student is a brand: its parts answer the questions of their sizes, the same one more than once maybe."""
    q = _rubric(s, d)
    a = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("student_id"), F.col("p_partkey").alias("row_no"), F.col("p_size").cast("string").alias("question_id"), said().alias("answer"))
    # Reports read it by student, by question and by status.
    return diagnose.diagnosis(scoring.score_answers(s, a, q, rubric.targets(q))).persist(StorageLevel.MEMORY_AND_DISK)


def open_score_full(s, d):
    return graded(s, d).select("student_id", "row_no", "question_id", rounded("score", 3).alias("score"), rounded("confidence", 2).alias("confidence"), "status", "error_type", "severity", "coverage")


def graded_traceability(s, d):
    return report.traceability(graded(s, d).withColumn("student_name", F.lower("student_id")))


def graded_judgements(s, d):
    return report.judgements(graded(s, d)).drop("basis")


def teacher_report(s, d):
    return report.teacher_report(graded(s, d), "Parts")


def technical_summary(s, d):
    return report.technical_summary(graded(s, d), "Parts", "parts.json")


def session_scores(s, d):
    """The wide sheet of a batch: a column for each of five questions, and the totals."""
    return report.sheets(graded(s, d), "Parts", "parts.json", "parts", ["1", "2", "3", "4", "5"])["scores"]


QUERIES = {f.__name__: f for f in (token_overlap_match, overlap_best_target, fuzzy_partial_ratio, semantic_match_full, open_score_full, graded_traceability, graded_judgements, teacher_report, technical_summary, session_scores)}

PAIRS = f"""a0 AS (
  SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) AS question_id, p_name || ' ' || p_type AS answer, {norm_sql("p_name || ' ' || p_type")} AS n FROM part
), a AS (
  SELECT *, {tokens_sql("n")} AS tokens, list_distinct({stems_sql(tokens_sql("n"))}) AS stems FROM a0
), t AS (
  SELECT p_partkey AS item_id, question_id, row_number() OVER (PARTITION BY question_id ORDER BY p_partkey) - 1 AS place, answer AS concept, n AS v, stems AS v_stems FROM a QUALIFY place < 3
), p AS (
  SELECT a.*, item_id, place, concept, v, v_stems FROM a JOIN t ON a.question_id = t.question_id
)"""
# The best alignment of the shorter text: longest common subsequences by the bits of its letters, over all windows.
RATIO = """u AS (
  SELECT DISTINCT n AS a, v AS b FROM p WHERE NOT contains(n, v) AND NOT contains(v, n)
), o AS (
  SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM u
  UNION ALL SELECT a, b, b, a FROM u WHERE length(a) = length(b)
), k AS (
  SELECT a, b, length(s) AS n, length(t) AS m, (1::BIGINT << length(s)) - 1 AS whole,
    list_transform(range(1, length(t) + 1), lambda j: CAST(list_sum(list_transform(range(0, length(s)), lambda i: CASE WHEN s[i + 1] = t[j] THEN 1::BIGINT << i ELSE 0::BIGINT END)) AS BIGINT)) AS bits FROM o
), w AS (
  SELECT a, b, n, m, whole, bits, unnest(range(1, n + m)) AS e FROM k
), x AS (
  SELECT a, b, n, least(e, m) - greatest(0, e - n) AS size, list_reduce(list_slice(bits, greatest(0, e - n) + 1, least(e, m)), lambda r, c: ((r + (r & c)) | (r - (r & c))) & whole, whole) AS r, whole FROM w
), pr AS (
  SELECT a, b, max(200.0::DOUBLE * (n - bit_count(r)) / (n + size)) AS pr FROM x GROUP BY a, b
), e AS (
  SELECT p.*, contains(n, v) AS has, contains(v, n) AS within, coalesce(pr.pr, 0.0::DOUBLE) AS pr, %s AS overlap FROM p LEFT JOIN pr ON pr.a = p.n AND pr.b = p.v
)""" % overlap_sql("stems", "v_stems")


def _decide(threshold: int, semantic: int) -> str:
    cases = [("n = '' OR v = ''", "false", "0", "empty"), ("has", "true", "100", "core"), ("within", "true", "86", "core"), (f"pr >= {threshold}", "true", "CAST(floor(pr) AS INTEGER)", "fuzzy"),
             (f"pr >= {semantic + 10}", "true", "CAST(floor(pr) AS INTEGER)", "synonym"), (f"overlap >= {semantic}", "true", "overlap", "overlap")]
    col = lambda i, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i] if i < 3 else repr(c[i])}" for c in cases) + f" ELSE {other} END"
    return f"{col(1, 'false')} AS ok, {col(2, 'greatest(CAST(floor(pr) AS INTEGER), overlap)')} AS score, {col(3, repr('none'))} AS method"


_GATE = texts._gate_value
GRADED = f"""{PAIRS}, {RATIO}, q AS (
  SELECT question_id, count(*) AS n_criteria FROM t GROUP BY question_id
), r AS (
  SELECT question_id, place, 1.0::DOUBLE + CASE WHEN place = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN {" OR ".join(f"contains(v, '{x}')" for x in lexicon.CENTRAL)} THEN 0.25::DOUBLE ELSE 0 END
    + CASE WHEN len(string_split(v, ' ')) >= 2 THEN 0.08::DOUBLE ELSE 0 END AS raw FROM t
), s AS (
  SELECT question_id, place, raw / sum(raw) OVER (PARTITION BY question_id) AS share FROM r
), d AS (
  SELECT DISTINCT question_id, n, place, concept, len(tokens) AS k, tokens, {profile_sql("len(tokens)")} AS profile, n IN {in_sql(lexicon.VAGUE)} OR n = '' AS vague, {_decide(68, 58)} FROM e
), f AS (
  SELECT d.*, CASE WHEN ok OR vague THEN 0.0::DOUBLE WHEN score >= 66 THEN CASE WHEN profile = 'developed' THEN 0.75 ELSE 0.62 END WHEN score >= 60 THEN CASE WHEN profile IN ('short', 'developed') THEN 0.62 ELSE 0.45 END
      WHEN score >= 54 THEN CASE WHEN profile = 'developed' THEN 0.48 ELSE 0.32 END WHEN score >= 48 THEN CASE WHEN profile = 'developed' THEN 0.32 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS factor,
    CASE WHEN n_criteria > 1 THEN share * {TOP}::DOUBLE ELSE 1.0::DOUBLE END AS w,
    CASE WHEN ok AND profile IN ('brief', 'short') THEN greatest(score / 100.0::DOUBLE, 0.72::DOUBLE) ELSE score / 100.0::DOUBLE END AS shown
  FROM d JOIN s USING (question_id, place) JOIN q USING (question_id)
), g0 AS (
  SELECT question_id, n, any_value(k) AS k, any_value(profile) AS profile, any_value(vague) AS vague, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS concepts, CAST(sum(CAST(factor > 0 AS INTEGER)) AS BIGINT) AS partial,
    CAST(sum(CAST(factor >= 0.30 AS INTEGER)) AS BIGINT) AS near, sum(CASE WHEN ok THEN w ELSE 0.0::DOUBLE END) AS gained, sum(w * factor) AS half, avg(shown) AS shown, count(*) AS wanted,
    coalesce(list_sort(list(concept) FILTER (NOT ok)), []) AS missing, {texts._labels_sql("n", lexicon.RELATIONS, lexicon.MORE_RELATIONS)} AS labels, len({texts._labels_sql("n", lexicon.RELATIONS)}) AS plain
  FROM f GROUP BY question_id, n
), g1 AS (
  SELECT *, len(labels) AS relations, len(list_filter(string_split(n, ' '), lambda x: x <> '')) AS n_words FROM g0
), g2 AS (
  SELECT *, {_GATE((0.20, 0.40, 0.65, 0.92), (0.08, 0.08, 0.05), 0.95)} AS g_partial, {_GATE((0.00, 0.15, 0.45, 0.85), (0.08, 0.12, 0.12), 0.90)} AS g_inference, {_GATE((0.25, 0.45, 0.70, 0.90), (0.05, 0.08, 0.10), 0.90)} AS g_relation,
    CASE WHEN vague THEN 'no evidence' WHEN k <= 3 THEN 'very brief' WHEN k <= 6 THEN 'brief' WHEN k <= 10 THEN 'sufficient' ELSE 'developed' END AS g_level FROM g1
), g3 AS (
  SELECT *, CASE WHEN g_level IN ('very brief', 'no evidence') THEN 0.0::DOUBLE ELSE least(0.22::DOUBLE, CASE WHEN relations >= 1 AND concepts + 0.55::DOUBLE * near >= 1 THEN 0.12::DOUBLE ELSE 0.0 END
      + CASE WHEN profile = 'developed' AND concepts + 0.55::DOUBLE * near >= 1.1 THEN 0.10::DOUBLE WHEN profile = 'short' AND concepts + 0.55::DOUBLE * near >= 1.5 THEN 0.06::DOUBLE ELSE 0.0 END) * g_inference END AS bonus,
    CASE WHEN concepts < 2 THEN 0.0::DOUBLE WHEN plain > 0 THEN least(0.20::DOUBLE, 0.07::DOUBLE * plain) WHEN n_words >= 8 THEN 0.05::DOUBLE ELSE 0.0 END AS r_bonus FROM g2
), g4 AS (
  SELECT *, greatest(0.0::DOUBLE, least({TOP}::DOUBLE, gained + half * g_partial + CASE WHEN concepts > 0 OR partial > 0 THEN {TOP}::DOUBLE * r_bonus * g_relation ELSE 0.0 END + {TOP}::DOUBLE * bonus)) AS score,
    0.48::DOUBLE * shown + 0.32::DOUBLE * least(1.0::DOUBLE, (concepts + 0.55::DOUBLE * partial) / greatest(wanted, 1)) + 0.20::DOUBLE AS t0, CAST(concepts AS DOUBLE) / greatest(wanted, 1) AS strict FROM g3
), g5 AS (
  SELECT *, CASE WHEN profile IN ('brief', 'short') AND concepts > 0 THEN greatest(t0, CASE WHEN strict < 0.80 THEN 0.68::DOUBLE ELSE 0.82::DOUBLE END) ELSE t0 END AS t1 FROM g4
), g6 AS (
  SELECT *, CASE WHEN partial > 0 THEN greatest(t1, CASE WHEN g_level IN ('very brief', 'brief') THEN 0.42::DOUBLE WHEN profile = 'developed' THEN 0.52::DOUBLE ELSE 0.46::DOUBLE END) ELSE t1 END AS t2 FROM g5
), g7 AS (
  SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN bonus > 0 THEN greatest(t2, 0.58::DOUBLE) ELSE t2 END)), 2) AS confidence, round(CAST(concepts AS DOUBLE) / wanted, 2) AS coverage,
    CASE WHEN n IN {in_sql(lexicon.VAGUE)} OR k <= 1 THEN 'vague' WHEN concepts = 0 THEN 'off focus' WHEN concepts < wanted AND profile IN ('brief', 'short') THEN 'brief and partial' WHEN concepts < wanted THEN 'incomplete'
      WHEN wanted >= 2 AND concepts >= 2 AND relations = 0 AND profile = 'developed' THEN 'weak relation' ELSE 'none' END AS error_type FROM g6
), b AS (
  SELECT p_brand AS student_id, p_partkey AS row_no, a.question_id, a.question_id AS item_id, answer, 'criteria' AS item_type, g7.score, {TOP}::DOUBLE AS max_score, confidence, concepts AS matched, partial, wanted, relations, labels, missing, profile, coverage,
    error_type, CASE error_type WHEN 'off focus' THEN 'high' WHEN 'vague' THEN 'medium' WHEN 'incomplete' THEN 'medium' WHEN 'weak relation' THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN confidence >= 0.82 THEN 'accepted' WHEN confidence < 0.48 THEN 'review' ELSE 'caution' END AS status
  FROM a JOIN g7 ON a.question_id = g7.question_id AND a.n = g7.n
)"""
_ITEMS = gradebook.items_body("question_id")
_SEEN = f"""{_ITEMS}, {gradebook.TOTALS}, o_ AS (
  SELECT count(*) AS answers, {", ".join(f"CAST(sum(CAST(status = '{s}' AS INTEGER)) AS BIGINT) AS {s}" for s in ("accepted", "caution", "review"))},
    (SELECT count(*) FROM totals) AS students, (SELECT avg(percent) FROM totals) AS percent, (SELECT count(*) FROM items) AS questions FROM b
), v AS (
  SELECT *, {", ".join(f"round(CAST({s} AS DOUBLE) / answers * 100.0::DOUBLE + 1e-9::DOUBLE, 1) AS {s}_pct" for s in ("accepted", "caution", "review"))},
    (SELECT string_agg(question_id, ', ' ORDER BY avg_pct, question_id) FROM (SELECT * FROM items ORDER BY avg_pct, question_id LIMIT 3)) AS hardest,
    (SELECT string_agg(question_id, ', ' ORDER BY avg_pct DESC, question_id DESC) FROM (SELECT * FROM items ORDER BY avg_pct DESC, question_id DESC LIMIT 3)) AS best,
    coalesce((SELECT string_agg(question_id, ', ' ORDER BY question_id) FROM items WHERE classification = 'needs review'), 'none') AS problems,
    (SELECT count(*) FROM items WHERE classification = 'needs review') AS n_problems, (SELECT avg(avg_pct) FROM items) AS ip, (SELECT avg(avg_confidence) FROM items) AS ic, (SELECT avg(review_pct) FROM items) AS ir FROM o_
)"""
_FEEDBACK = """CASE error_type WHEN 'vague' THEN 'Ask for more precise concepts; the answer is too general.' WHEN 'off focus' THEN 'Go over the core of the question; no expected idea was found.'
  WHEN 'brief and partial' THEN 'The core is right; ask for more where the rubric wants an explanation.' WHEN 'incomplete' THEN 'Missing: ' || array_to_string(list_slice(missing, 1, 4), ', ') || '.'
  WHEN 'weak relation' THEN 'Ask to connect the concepts by cause, function or consequence.'
  ELSE CASE WHEN len(labels) > 0 THEN 'Consistent; relations: ' || array_to_string(list_slice(labels, 1, 4), ', ') || '.' WHEN profile IN ('brief', 'short') THEN 'Acceptable but brief.' ELSE 'In line with the criteria.' END END"""
_SCORED = "round(score + 1e-9::DOUBLE, 3) AS score, round(confidence + 1e-9::DOUBLE, 2) AS confidence"
_ROWS = [
    ("product", "system", "'Marklake'"), ("summary", "rubric", "'Parts'"), ("summary", "students", "CAST(students AS VARCHAR)"), ("summary", "questions", "CAST(questions AS VARCHAR)"),
    ("results", "mean percent", "format('{:.1f}%', round(percent + 1e-9::DOUBLE, 1))"), ("results", "level", gradebook.level_sql("percent")), ("decisions", "accepted", "format('{:.1f}%', accepted_pct)"),
    ("decisions", "with caution", "format('{:.1f}%', caution_pct)"), ("decisions", "for review", "format('{:.1f}%', review_pct)"), ("items", "hardest", "hardest"), ("items", "best", "best"), ("items", "problems", "problems"),
    ("reading", "summary", f"format('Parts: {{}} students, {{}} performance, {{:.1f}}% of the score on average, mean confidence {{:.2f}}, {{:.1f}}% for manual review, {{}} items to revise.', students, {gradebook.level_sql('ip')}, round(ip + 1e-9::DOUBLE, 1), round(ic + 1e-9::DOUBLE, 2), round(ir + 1e-9::DOUBLE, 1), n_problems)"),
    ("advice", "use", "'" + report.USE + "'"),
]
_CELLS = ", ".join(f"round(sum(CASE WHEN question_id = '{i}' THEN score END) + 1e-9::DOUBLE, 2) AS q{i}_score" for i in range(1, 6))
ORACLE_SQL = {
    "token_overlap_match": f"WITH {PAIRS} SELECT p_partkey, item_id, {overlap_sql('stems', 'v_stems')} AS overlap FROM p",
    "overlap_best_target": f"WITH {PAIRS}, o AS (SELECT p_partkey, item_id, {overlap_sql('stems', 'v_stems')} AS overlap FROM p) SELECT p_partkey, item_id, overlap FROM o QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY overlap DESC, item_id) = 1",
    "fuzzy_partial_ratio": f"WITH {PAIRS}, {RATIO} SELECT p_partkey, item_id, has AS contains, list_has_any(string_split(n, ' '), {list(lexicon.NEGATORS)}) AS negated, overlap, round(pr + 1e-9::DOUBLE, 2) AS partial_ratio FROM e",
    "semantic_match_full": f"WITH {PAIRS}, {RATIO} SELECT p_partkey, item_id, {_decide(68, 62)} FROM e",
    "open_score_full": f"WITH {GRADED} SELECT student_id, row_no, question_id, {_SCORED}, status, error_type, severity, coverage FROM b",
    "graded_traceability": f"""WITH {GRADED} SELECT student_id, lower(student_id) AS student_name, question_id, status, {_SCORED}, profile, coverage, array_to_string(labels, ', ') AS relations, error_type, severity,
  format('coverage={{:.2f}}; relations={{}}; contradictions=0; profile={{}}', coverage, relations, profile) AS basis, {_FEEDBACK} AS feedback, answer FROM b""",
    "graded_judgements": f"""WITH {GRADED} SELECT student_id, question_id, profile, coverage, matched, partial, wanted AS concepts, CAST(relations AS INTEGER) AS relations, 0::BIGINT AS contradictions, error_type, severity,
  CASE WHEN score / max_score <= 0.05 THEN 'E0' WHEN score / max_score < 0.40 OR coverage < 0.30 THEN 'E1' WHEN score / max_score < 0.70 THEN 'E2' WHEN score / max_score < 0.90 OR relations = 0 THEN 'E3' WHEN profile = 'developed' AND confidence >= 0.75 THEN 'E4' ELSE 'E3' END AS cognitive_level,
  array_to_string(missing, ', ') AS missing FROM b""",
    "teacher_report": f"WITH {GRADED}, {_SEEN} " + " UNION ALL ".join(f"SELECT {i} AS place, '{a}' AS section, '{b}' AS indicator, {c} AS value FROM v" for i, (a, b, c) in enumerate(_ROWS)),
    "technical_summary": f"WITH {GRADED}, {_SEEN} SELECT 'Parts' AS rubric, 'parts.json' AS rubric_file, students, questions, answers, accepted, caution, review, accepted_pct, caution_pct, review_pct FROM v",
    "session_scores": f"WITH {GRADED}, {gradebook.TOTALS}, w_ AS (SELECT student_id, {_CELLS} FROM b GROUP BY student_id) SELECT w_.*, total, percent, {gradebook.level_sql('percent')} AS level FROM w_ JOIN totals USING (student_id)",
}
