"""Queries on photos, pages, recognized text, rubrics and sessions, over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.operators import capture, ocr, vision
from marklake.operators.insight import rounded
from marklake.functions import lexicon
from marklake.plans.texts import norm_sql
from marklake.shipping import spread
from marklake.sources import responses, rubric, sinks
from marklake.streaming import sessions

READ = lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet")


def boxes(s, d):
    """Parts as boxes, ten to a photo."""
    k = F.col("p_partkey")
    return READ(s, d, "part").select(
        F.floor(k / 10).alias("photo_id"), k.alias("box_id"), (k * 37 % 60).cast("double").alias("x"), (k * 53 % 60).cast("double").alias("y"), (F.col("p_size") + k % 7 * 8 + 5).cast("double").alias("w"),
        (F.col("p_size") + k % 5 * 9 + 5).cast("double").alias("h"), (F.col("p_retailprice") / 3000.0).alias("confidence"),
    )


def box_iou(s, d):
    a, b = boxes(s, d).alias("a"), boxes(s, d).alias("b")
    j = a.join(b, (F.col("a.photo_id") == F.col("b.photo_id")) & (F.col("a.box_id") < F.col("b.box_id")))
    return j.select(F.col("a.box_id").alias("one"), F.col("b.box_id").alias("other"), rounded(vision.iou("a", "b"), 4).alias("iou"), rounded(vision.contained("b", "a"), 4).alias("contained"))


def box_containment(s, d):
    return vision.drop_enclosing(boxes(s, d)).select("photo_id", "box_id")


def box_suppression(s, d):
    """Greedy, by descending confidence within a photo."""
    return vision.suppress(boxes(s, d), limit=0.4).select("photo_id", "box_id")


def visual_rows(s, d):
    return vision.visual_rows(boxes(s, d)).select("photo_id", "box_id", "visual_row", "place")


def page_chunking(s, d):
    """Lines of an order as the pages of a photo, four to a student."""
    p = READ(s, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("page_id"))
    return vision.chunk_pages(p.dropDuplicates(["photo_id", "page_id"]), 4, "photo_id", "page_id")


def page_groups(s, d):
    return vision.group_summary(page_chunking(s, d), "photo_id")


def corner_order(s, d):
    points = F.array(*[F.struct((F.col("x") + F.col("w") * i).alias("x"), (F.col("y") + F.col("h") * j).alias("y")) for i, j in ((1, 1), (0, 1), (1, 0), (0, 0))])
    c = boxes(s, d).select("box_id", vision.corners(points).alias("c"))
    return c.select("box_id", *[F.get("c", F.lit(i))[k].alias(f"{k}{i}") for i in range(4) for k in ("x", "y")])


def _photos(s, d):
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return READ(s, d, "lineitem").select(
        "l_orderkey", (F.lit(1000) + q * 10).cast("int").alias("width"), (F.lit(700) + k * 80).cast("int").alias("height"), (q * 4.0).alias("blur"), (F.col("l_tax") * 2500.0 + 30.0).alias("brightness"),
        (F.col("l_discount") * 600.0 + 10.0).alias("contrast"), (F.col("l_tax") * 5.0).alias("dark_ratio"), (F.col("l_discount") * 3.0).alias("bright_ratio"),
    )


def photo_quality_score(s, d):
    critical, secondary = vision.faults()
    p = _photos(s, d).select("l_orderkey", (vision.quality_score() + 0.0).alias("score"), critical.alias("critical"), secondary.alias("secondary"), vision.acceptable().alias("ok"))
    return p.groupBy("critical", "secondary", "ok").agg(F.count("*").alias("photos"), F.round(F.avg("score") + 1e-9, 1).alias("score"))


def ocr_state_band(s, d):
    e = ocr.state(F.lit(1.0) - F.col("l_discount") * 6, F.lit(1.0) - F.col("l_tax") * 8)
    return READ(s, d, "lineitem").groupBy(e.alias("state")).agg(F.count("*").alias("sessions"))


def ocr_router_coalesce(s, d):
    """Three engines over pages: one reads the first heading, one the first paragraph, one the title; each finds what the
    page has of it, and the router takes the first that found anything."""
    h = F.col("html")
    found = [(e, F.regexp_extract(h, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1), c) for e, t, c in ENGINES]
    r = ocr.routed([(e, t, F.lit(c)) for e, t, c in found])
    p = READ(s, d, "pages").select("page_id", r.alias("r"))
    return p.select("page_id", "r.engine", F.md5("r.text").alias("text"), "r.confidence", F.size(F.filter("r.attempts", lambda a: a["found"])).cast("long").alias("found"))


ENGINES = (("hosted", "h1", 0.88), ("neural", "p", 0.7), ("classic", "title", 0.5))


def ocr_status(s, d):
    """How the engines of the router did over all pages."""
    h = F.col("html")
    rows = [F.struct(F.lit(e).alias("engine"), F.lit(c).alias("confidence"), (F.trim(F.regexp_extract(h, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)) != "").alias("found"), F.when(h.isNull(), "no page").alias("message")) for e, t, c in ENGINES]
    attempts = READ(s, d, "pages").select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return ocr.engine_status(attempts, [e for e, _, _ in ENGINES] + ["spare"])


def prompt_stripping(s, d):
    """Pages' text as segments, whose prompt is the page's title."""
    p = READ(s, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", " "), r"\s+", " ")).alias("body"))
    out = ocr.strip_prompt("body", "title")
    return p.select("page_id", (out != F.col("body")).alias("stripped"), F.md5(out).alias("digest"))


def ocr_lines(s, d):
    """Words of documents as boxes, ten to a line."""
    w = spread(READ(s, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    w = w.select("doc_id", F.floor(F.col("pos") / 10).cast("int").alias("line_no"), (F.col("pos") % 10 * 7).cast("int").alias("left"), "text", (F.col("pos") % 11 * 10.0 - 10.0).alias("confidence"))
    t = ocr.page_text(ocr.lines(w, ["doc_id"], ["line_no"]), ["doc_id"], ["line_no"])
    return t.select("doc_id", F.md5("text").alias("digest"))


def joined_pages(s, d):
    """The turns of a conversation as the pages of a session."""
    c = READ(s, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    j = ocr.joined_pages(c, "session", "turn")
    return j.select("session", F.length("text").alias("length"), F.md5("text").alias("digest"))


def segment_by_markers(s, d):
    k = F.col("p_partkey")
    t = F.concat(F.lit("Name "), F.lit("\n1) "), F.col("p_name"), F.when(k % 2 == 0, "\nP2. ").otherwise("\n pregunta 2: "), F.col("p_brand"), F.lit("\n3 - "), F.col("p_type"), F.lit("\n1) again"))
    return ocr.segments_by_marker(READ(s, d, "part").select(k, t.alias("text")), "p_partkey")


SHEET = ("1) ", "\npregunta 2: ", "\nP3. ", "\n  4 - ")


def segment_documents(s, d):
    """The whole segmenter over sheets: the first four user turns of a conversation, each under a marker of another
    shape, and all later ones after the last; against a rubric of five questions."""
    c = READ(s, d, "conversations").filter("role = 'user'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    mark = F.coalesce(F.get(F.array(*[F.lit(m) for m in SHEET]), F.col("place") - 1), F.lit("\n"))
    c = c.withColumn("place", place).withColumn("part", F.concat(mark, "text"))
    sheets = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("text"))
    out = ocr.segment_documents(sheets, "conv_id", [(f"P{i}", "") for i in range(1, 6)])
    return out.select("conv_id", "question_id", F.md5("segment").alias("digest"), "mode", rounded("confidence", 2).alias("confidence"))


def rubric_files(s, d):
    """Rubrics as JSON files, one for each region with its nations as questions, written under their own names, listed in
    the catalog, chosen by name and read back as questions and targets."""
    n = READ(s, d, "nation").join(READ(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    root = f"{(s.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='marklake-rubrics-')).rstrip('/')}/rubrics-{uuid.uuid4().hex[:12]}"
    question = F.struct(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Completar").alias("item_type"), (F.col("n_nationkey") % 4 + 1.0).alias("max_score"), F.array("n_name").alias("accepted_answers"))
    docs = n.groupBy("r_name").agg(F.sort_array(F.collect_list(question)).alias("questions")).select(F.concat(F.lit("Rubric of "), "r_name").alias("name"), "questions")
    for r in docs.select("name").collect():  # one file for each rubric
        sinks.persist_rubric(docs.filter(F.col("name") == r.name), root, r.name)
    found, out = rubric.read_documents(s, f"{root}/*"), None
    for r in rubric.catalog(s, f"{root}/*").collect():
        q = rubric.questions(rubric.select_rubric(found, r.file_name)).withColumn("rubric", F.lit(r.label))
        t = rubric.targets(q).filter("role = 'accepted'").groupBy("question_id").agg(F.count("*").alias("targets"), F.min("variant_norm").alias("accepted"))
        part = q.join(t, q.id == t.question_id).select("rubric", "q_pos", "id", "item_type", rubric.type_label("item_type").alias("label"), "max_score", "targets", "accepted")
        out = part if out is None else out.unionByName(part)
    return out


def capture_columns(s, d):
    """What is derived of a page: geometry, quality light, labels, the gates before recognition."""
    b = capture.derived(boxes(s, d).withColumn("photo", F.col("photo_id")))
    ok = F.col("confidence") >= 0.4
    said = capture.warnings([F.when(F.col("aspect_ratio") > 2, F.array(F.lit("wide"))).otherwise(F.array().cast("array<string>")), F.when(F.col("area") < 500, F.array(F.lit("small"), F.lit("wide"))).otherwise(F.array().cast("array<string>"))])
    b = b.withColumn("complete", F.col("box_id") % 10 < 8).withColumn("said", said)
    return b.select(
        "box_id", "center_x", "center_y", "area", rounded("aspect_ratio", 4).alias("aspect_ratio"), F.array_join("said", ",").alias("warnings"), capture.requires_confirmation(F.col("complete"), F.col("said"), ok).alias("confirm"),
        capture.ready_for_ocr(F.lit(True), ok, F.col("box_id"), F.col("box_id") % 3).alias("ready"), capture.page_label(F.col("photo_id"), F.col("box_id") % 4 + 1, F.col("complete")).alias("label"),
        rounded(vision.detection_confidence(F.col("confidence"), F.col("area") / 4000.0, F.col("x") <= 0), 4).alias("detection"), ocr.safe_gate(F.col("box_id") % 3, F.col("box_id") % 2, F.col("confidence"), F.lit(4), F.lit(True)).alias("gate"),
        capture.data_url(F.col("box_id").cast("string").cast("binary")).alias("data_url"),
    )


def session_ttl_active(s, d):
    e = READ(s, d, "events").select("event_id", F.col("ts").alias("created_at"))
    return sessions.active(e, F.lit("2024-01-15 12:00:00").cast("timestamp"), "6 hours").filter("created_at <= timestamp '2024-01-15 12:00:00'").select("event_id")


def session_first_use(s, d):
    e = READ(s, d, "events").withColumn("key", F.struct("ts", "event_id"))
    return sessions.first_use(e, "user_id", "key").select("user_id", "event_id")


def windowed_statistics(s, d):
    return sessions.windowed(READ(s, d, "events").filter("ts is not null"), "ts", "event_type", "value")


def streaming_item_stats(s: SparkSession, d: str) -> DataFrame:
    """The same windows out of a stream, run until it has nothing more."""
    # Watermarks want an instant; the table's times are without a zone and are taken as the session's.
    stream = s.readStream.schema(READ(s, d, "events").schema).parquet(_events_folder(s, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    root = (s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="marklake-stream-")).rstrip("/")
    out = f"{root}/stream-{uuid.uuid4().hex[:12]}"
    query = sessions.windowed(stream, "ts", "event_type", "value").writeStream.outputMode("complete").option("checkpointLocation", f"{out}-log")
    query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _events_folder(s: SparkSession, d: str) -> str:
    """A folder of events for the stream's file source, which cannot read a single file."""
    p = s._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    fs = p.getFileSystem(s._jsc.hadoopConfiguration())
    return f"{d}/events.parquet" if fs.getFileStatus(p).isDirectory() else f"{d}/event[s].parquet"


def answers_unpivot(s, d):
    wide = READ(s, d, "customer").select(F.col("c_custkey").alias("RUT"), F.col("c_name").alias("Nombre"), F.col("c_mktsegment").alias("P1"), F.col("c_nationkey").alias("Pregunta 2"), F.round("c_acctbal", 0).cast("long").alias("item_3"))
    return responses.unpivot(wide, ["P1", "P2", "P3", "P4"]).drop("row_no")


def _flat_rubric(s, d):
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Completar", "V/F", "Pregunta abierta", "Relacionar", "Enumerar")]), (k % 5 + 1).cast("int"))
    ideas = F.when(k % 7 == 3, "").when(k % 5 == 3, F.concat("n_name", F.lit(": a; B: b"))).otherwise(F.concat("n_name", F.lit("; otra cosa")))
    return READ(s, d, "nation").select(F.when(k % 10 == 9, "P9").otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("Pregunta"), kind.alias("Tipo de pregunta"), (k % 4).cast("double").alias("Puntaje"), ideas.alias("Ideas esperadas"), F.lit("").alias("Enunciado"))


def rubric_questions(s, d):
    q = rubric.from_table(_flat_rubric(s, d))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return q.select("id", "item_type", "max_score", n("accepted_answers").alias("accepted"), n("criteria").alias("n_criteria"), n("pairs").alias("n_pairs"))


def rubric_integrity(s, d):
    return rubric.integrity_issues(rubric.from_table(_flat_rubric(s, d)))


def upload_guard(s, d):
    """Pages as uploads: their lengths and made-up kinds."""
    k = F.col("page_id")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".gif", "")]), (k % 4 + 1).cast("int"))
    f = READ(s, d, "pages").select("page_id", F.concat(F.lit("/up/"), k.cast("string"), suffix).alias("path"), F.when(k % 7 == 0, 0).otherwise(F.length("html") * 5000).cast("long").alias("length"))
    return capture.guard(f).select("page_id", F.coalesce("rejected", F.lit("accepted")).alias("outcome"))


def edited_answers(s, d):
    """Turns as segments; every third was edited, every fifth to nothing."""
    c = READ(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("segment"), "role")
    e = c.filter("turn % 3 = 0").select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, "  ").otherwise(F.concat(F.lit(" fixed "), "role")).alias("answer"))
    return capture.edited_answers(c.drop("role"), e, ["conv_id", "turn"])


def student_gate(s, d):
    c = READ(s, d, "conversations").select("conv_id", F.when(F.col("conv_id") % 4 == 0, " ").otherwise(F.col("text")).alias("answer"))
    return capture.student_gate(c, "conv_id")


def class_average(s, d):
    r = READ(s, d, "orders").select((F.col("o_totalprice") / 5000.0).alias("percent"), F.when(F.col("o_orderkey") % 9 == 0, "no answers").alias("error"))
    return capture.class_average(r)


_BOX = """x AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS photo_id, p_partkey AS box_id, CAST(p_partkey * 37 % 60 AS DOUBLE) AS x, CAST(p_partkey * 53 % 60 AS DOUBLE) AS y,
  CAST(p_size + p_partkey % 7 * 8 + 5 AS DOUBLE) AS w, CAST(p_size + p_partkey % 5 * 9 + 5 AS DOUBLE) AS h FROM part)"""
_BOTH = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS answers, round(sum(value) + 1e-9::DOUBLE, 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
_FLAT = """f AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 10 = 9 THEN 'P9' ELSE 'P' || n_nationkey END AS id,
  ['completion', 'true_false', 'criteria', 'classification_matching', 'enumeration_conceptual'][n_nationkey % 5 + 1] AS item_type, CAST(n_nationkey % 4 AS DOUBLE) AS max_score, n_nationkey % 7 = 3 AS bare FROM nation)"""
# The shapes of a question's marker, in the order in which they are tried.
_SHAPES = ["'\\bP' || i || '\\b'", "'\\bp\\s*' || i || '\\b'", "'\\bpregunta\\s*' || i || '\\b'", "'\\bitem\\s*' || i || '\\b'", "'(?m:^)\\s*' || i || '\\s*[).:-]'"]
QUERIES = {f.__name__: f for f in (
    box_iou, box_containment, box_suppression, visual_rows, page_chunking, page_groups, corner_order, photo_quality_score, ocr_state_band, ocr_router_coalesce, ocr_lines, joined_pages,
    segment_by_markers, segment_documents, session_ttl_active, session_first_use, windowed_statistics, streaming_item_stats, answers_unpivot, rubric_questions, rubric_integrity,
    upload_guard, edited_answers, student_gate, class_average, ocr_status, prompt_stripping, rubric_files, capture_columns,
)}
ORACLE_SQL = {
    "capture_columns": f"""WITH {_BOX}, c AS (SELECT *, p_retailprice / 3000.0::DOUBLE AS confidence, w * h AS area, CASE WHEN h > 0 THEN w / h ELSE 0.0::DOUBLE END AS ratio, box_id % 10 < 8 AS complete FROM x JOIN part ON p_partkey = box_id), n AS (
  SELECT *, CASE WHEN ratio > 2 AND area < 500 THEN 'wide,small' WHEN ratio > 2 THEN 'wide' WHEN area < 500 THEN 'small,wide' ELSE '' END AS said FROM c)
SELECT box_id, x + w / 2 AS center_x, y + h / 2 AS center_y, area, round(ratio + 1e-9::DOUBLE, 4) AS aspect_ratio, said AS warnings, NOT complete OR said <> '' OR NOT confidence >= 0.4::DOUBLE AS confirm, confidence >= 0.4::DOUBLE AND box_id > 0 AND box_id % 3 = 0 AS ready,
  'student ' || photo_id || ', page ' || (box_id % 4 + 1) || CASE WHEN complete THEN '' ELSE ' (incomplete)' END AS label,
  round(0.5::DOUBLE * confidence + 0.3::DOUBLE * least(1.0::DOUBLE, area / 4000.0::DOUBLE / 0.5::DOUBLE) + 0.2::DOUBLE * CASE WHEN x <= 0 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END + 1e-9::DOUBLE, 4) AS detection,
  CASE WHEN box_id % 3 = 0 THEN 'no answers' WHEN box_id % 2 = 0 AND confidence < 0.48::DOUBLE AND box_id % 3 <= 1 THEN 'uncertain segmentation' END AS gate, 'data:image/jpeg;base64,' || base64(encode(CAST(box_id AS VARCHAR))) AS data_url FROM n""",
    "rubric_files": f"""SELECT 'Rubric of ' || r_name AS rubric, CAST(row_number() OVER (PARTITION BY r_name ORDER BY 'P' || n_nationkey) - 1 AS INTEGER) AS q_pos, 'P' || n_nationkey AS id, 'completion' AS item_type, '{lexicon.TYPE_LABELS["completion"]}' AS label, n_nationkey % 4 + 1.0::DOUBLE AS max_score,
  1::BIGINT AS targets, {norm_sql("n_name")} AS accepted FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "segment_documents": f"""WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), s AS (
  SELECT conv_id, string_agg(CASE place WHEN 1 THEN '1) ' WHEN 2 THEN chr(10) || 'pregunta 2: ' WHEN 3 THEN chr(10) || 'P3. ' WHEN 4 THEN chr(10) || '  4 - ' ELSE chr(10) END || text, '' ORDER BY place) AS t FROM c GROUP BY conv_id
), b AS (SELECT conv_id, regexp_replace(regexp_replace(t, '(?m)^(\\s*\\d{{1,2}})\\s+(\\S)', '\\1. \\2', 'g'), '(?i)\\bpreg\\.?\\s*(\\d+)', 'Pregunta \\1', 'g') AS b FROM s), m AS (
  SELECT conv_id, b, i, list_filter([{", ".join(f"[regexp_extract(b, '(?is)^(.*?)(' || {shape} || ')', 1), regexp_extract(b, '(?is)^(.*?)(' || {shape} || ')', 2)]" for shape in _SHAPES)}], lambda x: x[2] <> '')[1] AS hit FROM b, range(1, 6) r(i)
), k AS (SELECT conv_id, b, i, length(hit[1]) AS start, length(hit[1]) + length(hit[2]) AS stop FROM m WHERE hit IS NOT NULL), n AS (
  SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, stop) AS next, count(*) OVER (PARTITION BY conv_id) AS marks FROM k
), f AS (SELECT conv_id, i, trim(regexp_replace(substr(b, stop + 1, coalesce(next, length(b)) - stop), '^[\\s).:\\-–]+', ''), ' ' || chr(10) || chr(9) || chr(13)) AS seg FROM n WHERE marks >= 2), a AS (
  SELECT b.conv_id, r.i, coalesce(f.seg, '') AS seg, EXISTS (SELECT 1 FROM f x WHERE x.conv_id = b.conv_id) AS marked, b.b, (SELECT count(*) FROM f x WHERE x.conv_id = b.conv_id AND seg <> '') AS filled FROM b, range(1, 6) r(i) LEFT JOIN f ON f.conv_id = b.conv_id AND f.i = r.i
) SELECT conv_id, 'P' || i AS question_id, md5(CASE WHEN marked THEN seg WHEN i = 1 THEN trim(b, ' ' || chr(10)) ELSE '' END) AS digest, CASE WHEN marked THEN 'markers' ELSE 'whole' END AS mode,
  round(CASE WHEN marked THEN least(0.92::DOUBLE, 0.40::DOUBLE + 0.08::DOUBLE * filled) ELSE 0.25::DOUBLE END + 1e-9::DOUBLE, 2) AS confidence FROM a""",
    "visual_rows": f"""WITH RECURSIVE {_BOX}, o AS (SELECT photo_id, box_id, y + h / 2 AS cy, x + w / 2 AS cx, 0.45::DOUBLE * median(h) OVER (PARTITION BY photo_id) AS reach, row_number() OVER (PARTITION BY photo_id ORDER BY y + h / 2, x + w / 2, box_id) AS k FROM x), g AS (
  SELECT photo_id, 0 AS k, CAST([] AS DOUBLE[]) AS sums, CAST([] AS BIGINT[]) AS counts, CAST(NULL AS BIGINT) AS slot FROM o GROUP BY photo_id
  UNION ALL SELECT photo_id, k, CASE WHEN hit IS NULL THEN list_append(sums, cy) ELSE list_transform(range(1, len(sums) + 1), lambda i: sums[i] + CASE WHEN i = hit THEN cy ELSE 0 END) END,
    CASE WHEN hit IS NULL THEN list_append(counts, 1) ELSE list_transform(range(1, len(sums) + 1), lambda i: counts[i] + CASE WHEN i = hit THEN 1 ELSE 0 END) END, coalesce(hit, len(sums) + 1)
  FROM (SELECT g.photo_id, a.k, g.sums, g.counts, a.cy, list_filter(range(1, len(g.sums) + 1), lambda i: abs(g.sums[i] / g.counts[i] - a.cy) <= a.reach)[1] AS hit FROM g JOIN o a ON a.photo_id = g.photo_id AND a.k = g.k + 1)
), f AS (SELECT photo_id, arg_max(sums, k) AS sums, arg_max(counts, k) AS counts FROM g GROUP BY photo_id), r AS (
  SELECT o.photo_id, box_id, cx, o.k, slot, f.sums[slot] / f.counts[slot] AS mean FROM o JOIN g ON g.photo_id = o.photo_id AND g.k = o.k JOIN f ON f.photo_id = o.photo_id)
SELECT photo_id, box_id, CAST(dense_rank() OVER (PARTITION BY photo_id ORDER BY mean, slot) - 1 AS INTEGER) AS visual_row, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY mean, slot, cx, k) AS INTEGER) AS place FROM r""",
    "box_suppression": f"""WITH RECURSIVE {_BOX}, c AS (SELECT *, p_retailprice / 3000.0::DOUBLE AS confidence FROM x JOIN part ON p_partkey = box_id), o AS (
  SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, box_id) AS k FROM c), g AS (
  SELECT photo_id, 0 AS k, CAST([] AS BIGINT[]) AS kept FROM o GROUP BY photo_id
  UNION ALL SELECT g.photo_id, g.k + 1, CASE WHEN EXISTS (SELECT 1 FROM x b WHERE list_contains(g.kept, b.box_id) AND {_BOTH} >= 0.4::DOUBLE * (a.w * a.h + b.w * b.h - {_BOTH})) THEN g.kept ELSE list_append(g.kept, a.box_id) END
  FROM g JOIN o a ON a.photo_id = g.photo_id AND a.k = g.k + 1
), l AS (SELECT photo_id, unnest(arg_max(kept, k)) AS box_id FROM g GROUP BY photo_id)
SELECT l.photo_id, box_id FROM l JOIN x USING (box_id) QUALIFY row_number() OVER (PARTITION BY l.photo_id ORDER BY y + h / 2, x + w / 2) <= 20""",
    "prompt_stripping": f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages), n AS (
  SELECT *, {norm_sql("title")} AS t, {norm_sql("body")} AS b, string_split(body, ' ') AS w FROM p), o AS (
  SELECT page_id, body, CASE WHEN t <> '' AND contains(b, left(t, 55)) AND len(w) > len(string_split(t, ' ')) THEN array_to_string(list_slice(w, len(string_split(t, ' ')) + 1, len(w)), ' ') ELSE body END AS o FROM n
) SELECT page_id, o <> body AS stripped, md5(o) AS digest FROM o""",
    "ocr_status": f"""WITH e AS ({" UNION ALL ".join(f"SELECT '{e}' AS engine, {c}::DOUBLE AS c, trim(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1)) <> '' AS found, html IS NULL AS bad FROM pages" for e, t, c in ENGINES)})
SELECT engine, count(*) AS tried, CAST(sum(CAST(found AS INTEGER)) AS BIGINT) AS found, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS failed, coalesce(round(avg(CASE WHEN found THEN c END) + 1e-9::DOUBLE, 2), 0.0::DOUBLE) AS confidence,
  count(*) > sum(CAST(bad AS INTEGER)) AS available FROM e GROUP BY engine UNION ALL SELECT 'spare', 0, 0, 0, 0.0::DOUBLE, false""",
    "box_iou": f"WITH {_BOX} SELECT a.box_id AS one, b.box_id AS other, round({_BOTH} / (a.w * a.h + b.w * b.h - {_BOTH}) + 1e-9::DOUBLE, 4) AS iou, round({_BOTH} / (b.w * b.h) + 1e-9::DOUBLE, 4) AS contained FROM x a JOIN x b ON a.photo_id = b.photo_id AND a.box_id < b.box_id",
    "box_containment": f"""WITH {_BOX}, h AS (SELECT a.box_id FROM x a JOIN x b ON a.photo_id = b.photo_id AND a.box_id <> b.box_id AND b.w * b.h < a.w * a.h * 0.78::DOUBLE AND {_BOTH} / (b.w * b.h) >= 0.88
  GROUP BY a.box_id HAVING count(*) >= 2 AND sum(b.w * b.h) / first(a.w * a.h) >= 0.38) SELECT photo_id, box_id FROM x WHERE box_id NOT IN (SELECT box_id FROM h)""",
    "page_chunking": """WITH p AS (SELECT photo_id, page_id, row_number() OVER (PARTITION BY photo_id ORDER BY page_id) - 1 AS n FROM (SELECT DISTINCT l_orderkey AS photo_id, l_linenumber * 1000000 + l_partkey AS page_id FROM lineitem)), c AS (
  SELECT photo_id, page_id, CAST(floor(n / 4) + 1 AS INTEGER) AS student_number, CAST(n % 4 + 1 AS INTEGER) AS page_number FROM p) SELECT *, count(*) OVER (PARTITION BY photo_id, student_number) = 4 AS complete FROM c""",
    "page_groups": "WITH p AS (SELECT l_orderkey AS photo_id, count(DISTINCT l_linenumber * 1000000 + l_partkey) AS pages FROM lineitem GROUP BY 1) SELECT photo_id, CAST(ceil(pages / 4.0) AS BIGINT) AS groups, CAST(floor(pages / 4.0) AS BIGINT) AS complete_groups, pages FROM p",
    "corner_order": f"WITH {_BOX} SELECT box_id, x AS x0, y AS y0, x + w AS x1, y AS y1, x + w AS x2, y + h AS y2, x AS x3, y + h AS y3 FROM x",
    "photo_quality_score": """WITH p AS (SELECT CAST(1000 + l_quantity * 10 AS INTEGER) AS width, 700 + l_linenumber * 80 AS height, l_quantity * 4.0::DOUBLE AS blur, l_tax * 2500.0::DOUBLE + 30.0::DOUBLE AS brightness,
  l_discount * 600.0::DOUBLE + 10.0::DOUBLE AS contrast, l_tax * 5.0::DOUBLE AS dark, l_discount * 3.0::DOUBLE AS bright FROM lineitem), q AS (
  SELECT round(CASE WHEN width >= 1200 AND height >= 900 THEN 100.0::DOUBLE ELSE 45.0::DOUBLE END * 0.15::DOUBLE + least(100.0::DOUBLE, blur / 85.0::DOUBLE * 80) * 0.30::DOUBLE + greatest(0.0::DOUBLE, 100.0::DOUBLE - abs(brightness - 135) * 0.85::DOUBLE) * 0.20::DOUBLE
    + least(100.0::DOUBLE, contrast / 28.0::DOUBLE * 75) * 0.15::DOUBLE + greatest(0.0::DOUBLE, 100.0::DOUBLE - dark / 0.35::DOUBLE * 50) * 0.10::DOUBLE + greatest(0.0::DOUBLE, 100.0::DOUBLE - bright / 0.25::DOUBLE * 50) * 0.10::DOUBLE, 1) AS score,
    CAST(width < 1200 OR height < 900 AS INTEGER) + CAST(blur < 85 AS INTEGER) + CAST(NOT (brightness BETWEEN 45 AND 220) AS INTEGER) AS critical,
    CAST(contrast < 28 AS INTEGER) + CAST(dark > 0.35::DOUBLE AS INTEGER) + CAST(bright > 0.25::DOUBLE AS INTEGER) AS secondary FROM p
) SELECT critical, secondary, critical = 0 AND secondary <= 1 AS ok, count(*) AS photos, round(avg(score) + 1e-9::DOUBLE, 1) AS score FROM q GROUP BY ALL""",
    "ocr_state_band": "WITH s AS (SELECT (1.0::DOUBLE - l_discount * 6) * 0.65::DOUBLE + (1.0::DOUBLE - l_tax * 8) * 0.35::DOUBLE AS s FROM lineitem) SELECT CASE WHEN s >= 0.78 THEN 'green' WHEN s >= 0.48 THEN 'yellow' ELSE 'red' END AS state, count(*) AS sessions FROM s GROUP BY 1",
    "ocr_router_coalesce": f"""WITH e AS (SELECT page_id, {", ".join(f"regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1) AS t{i}" for i, (_, t, _) in enumerate(ENGINES))} FROM pages)
SELECT page_id, CASE {" ".join(f"WHEN trim(t{i}) <> '' THEN '{e}'" for i, (e, _, _) in enumerate(ENGINES))} ELSE 'manual' END AS engine, md5(CASE {" ".join(f"WHEN trim(t{i}) <> '' THEN t{i}" for i in range(3))} ELSE '' END) AS text,
  CAST(CASE {" ".join(f"WHEN trim(t{i}) <> '' THEN {c}" for i, (_, _, c) in enumerate(ENGINES))} ELSE 0.0 END AS DOUBLE) AS confidence, {" + ".join(f"CAST(trim(t{i}) <> '' AS BIGINT)" for i in range(3))} AS found FROM e""",
    "ocr_lines": """WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS t FROM documents),
l AS (SELECT doc_id, floor(pos / 10) AS line, string_agg(t, ' ' ORDER BY pos) AS line_text FROM w GROUP BY 1, 2) SELECT doc_id, md5(string_agg(line_text, chr(10) ORDER BY line)) AS digest FROM l GROUP BY doc_id""",
    "joined_pages": """WITH p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), j AS (
  SELECT conv_id, string_agg('[PAGE ' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS t FROM p GROUP BY conv_id) SELECT conv_id AS session, CAST(length(t) AS INTEGER) AS length, md5(t) AS digest FROM j""",
    "segment_by_markers": "SELECT p_partkey, 1 AS number, p_name AS segment FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part UNION ALL SELECT p_partkey, 3, p_type FROM part",
    "session_ttl_active": "SELECT event_id FROM events WHERE ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-15 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'",
    "session_first_use": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "windowed_statistics": _WINDOWS,
    "streaming_item_stats": _WINDOWS,
    "answers_unpivot": """SELECT CAST(c_custkey AS VARCHAR) AS student_id, c_name AS student_name, 'P1' AS question_id, 'P1' AS source_column, c_mktsegment AS answer FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'P2', 'Pregunta 2', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'P3', 'item_3', CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS VARCHAR) FROM customer""",
    "rubric_questions": f"""WITH {_FLAT} SELECT id, item_type, max_score, CAST(CASE WHEN bare OR k % 5 IN (2, 3) THEN 0 ELSE 2 END AS BIGINT) AS accepted, CAST(CASE WHEN bare OR k % 5 <> 2 THEN 0 ELSE 2 END AS BIGINT) AS n_criteria,
  CAST(CASE WHEN bare OR k % 5 <> 3 THEN 0 ELSE 2 END AS BIGINT) AS n_pairs FROM f""",
    "upload_guard": """SELECT page_id, CASE WHEN page_id % 4 > 1 THEN 'kind' WHEN page_id % 7 = 0 THEN 'empty' WHEN length(html) * 5000 > 20971520 THEN 'too large' ELSE 'accepted' END AS outcome FROM pages""",
    "edited_answers": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 5 <> 0 THEN 'fixed ' || role ELSE text END AS answer, turn % 3 = 0 AND turn % 5 <> 0 AS direct FROM conversations",
    "student_gate": "SELECT conv_id, bool_or(conv_id % 4 <> 0 AND trim(text) <> '') AS answered, CASE WHEN NOT bool_or(conv_id % 4 <> 0 AND trim(text) <> '') THEN 'no answers' END AS error FROM conversations GROUP BY conv_id",
    "class_average": "SELECT round(avg(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 5000.0::DOUBLE END) + 1e-9::DOUBLE, 2) AS average, CAST(sum(CAST(o_orderkey % 9 <> 0 AS INTEGER)) AS BIGINT) AS valid, CAST(sum(CAST(o_orderkey % 9 = 0 AS INTEGER)) AS BIGINT) AS failed FROM orders",
    "rubric_integrity": f"""WITH {_FLAT}, c AS (SELECT *, count(*) OVER (PARTITION BY id) AS copies FROM f) SELECT id, 'repeated id' AS issue FROM c WHERE copies > 1 UNION ALL SELECT id, 'max_score is not positive' FROM c WHERE max_score <= 0
UNION ALL SELECT id, CASE item_type WHEN 'criteria' THEN 'open question without criteria and answers' WHEN 'classification_matching' THEN 'matching question without pairs' ELSE 'closed question without accepted answers' END FROM c WHERE bare""",
}
