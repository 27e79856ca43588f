"""Text out of photos: lines from words, the choice of an engine, states, and segments by question."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.functions import text
from marklake.shipping import ship


def lines(words: DataFrame, page: list[str], line: list[str]) -> DataFrame:
    """Lines of a page's words (left, text, confidence), read from left to right, and their mean confidence
    (negative ones do not count)."""
    w = words.groupBy(*page, *line).agg(F.array_sort(F.collect_list(F.struct("left", "text"))).alias("w"), F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("confidence"))
    return w.select(*page, *line, F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"), F.round(F.col("confidence") / 100.0, 2).alias("confidence"))


def box_lines(boxes: DataFrame, page: list[str], height: float = 18.0) -> DataFrame:
    """Lines of boxes (top, left, text, confidence): those whose tops round to one row."""
    return lines(boxes.withColumn("row", F.round(F.col("top") / height).cast("int")), page, ["row"])


def page_text(rows: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """One text for each page, its lines in order."""
    t = rows.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("l"), F.avg("confidence").alias("confidence"))
    return t.select(*page, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), F.round("confidence", 2).alias("confidence"))


def joined_pages(pages: DataFrame, session: str, order: str) -> DataFrame:
    """All page texts of a session, each under its number."""
    p = pages.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("p"))
    body = F.transform("p", lambda x, i: F.concat(F.lit("[PAGE "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(x["text"], F.lit(""))))
    return p.select(session, F.array_join(body, "\n\n").alias("text"))


def routed(results: list[tuple[str, Column, Column]]) -> Column:
    """struct(engine, text, confidence, attempts) of the first engine, in order, that gave any text."""
    attempts = F.array(*[F.struct(F.lit(n).alias("engine"), F.coalesce(c, F.lit(0.0)).alias("confidence"), (F.trim(F.coalesce(t, F.lit(""))) != "").alias("found")) for n, t, c in results])
    out = None
    for name, t, c in results:
        found = F.trim(F.coalesce(t, F.lit(""))) != ""
        pick = F.struct(F.lit(name).alias("engine"), t.alias("text"), c.alias("confidence"))
        out = F.when(found, pick) if out is None else out.when(found, pick)
    manual = F.struct(F.lit("manual").alias("engine"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"))
    pick = out.otherwise(manual)
    return F.struct(pick["engine"].alias("engine"), pick["text"].alias("text"), pick["confidence"].alias("confidence"), attempts.alias("attempts"))


def response_text(json_column: Column | str) -> Column:
    """The text of a hosted engine's answer: its pages' markdown, text or content; else its own."""
    page = "struct<markdown: string, text: string, content: string>"
    r = F.from_json(text.col(json_column), f"struct<pages: array<{page}>, text: string, markdown: string, content: string>")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    pages = F.array_compact(F.transform(r["pages"], lambda p: F.coalesce(some(p["markdown"]), some(p["text"]), some(p["content"]))))
    return F.coalesce(F.nullif(F.array_join(pages, "\n\n"), F.lit("")), some(r["text"]), some(r["markdown"]), some(r["content"]), F.lit(""))


def state(ocr: Column, segmentation: Column) -> Column:
    s = ocr * F.lit(0.65) + segmentation * F.lit(0.35)
    return F.when(s >= 0.78, "green").when(s >= 0.48, "yellow").otherwise("red")


def segments_by_marker(documents: DataFrame, key: str, marker: str = r"(?i)(?:^|\n)\s*(?:pregunta|p|item|question|q)?\s*(\d{1,2})\s*[).:-]") -> DataFrame:
    """key, number, segment: the text from each question's first marker to the next marker's line.  All native:
    markers by regular expression, first of a number by window, the end by the next start."""
    found = F.regexp_extract_all("text", F.lit(marker), F.lit(1))
    parts = F.split("text", marker)
    d = documents.withColumn("numbers", found).withColumn("parts", parts).select(key, F.posexplode(F.arrays_zip("numbers", F.slice("parts", 2, F.greatest(F.lit(1), F.size("parts") - 1)).alias("segment"))).alias("pos", "m"))
    first = F.row_number().over(Window.partitionBy(key, "number").orderBy("pos"))
    d = d.select(key, "pos", F.col("m.numbers").cast("int").alias("number"), F.trim(F.regexp_replace(F.col("m.segment"), r"\s+", " ")).alias("segment")).filter("number is not null")
    return d.withColumn("n", first).filter("n = 1").select(key, "number", "segment")


def strip_prompt(segment: Column | str, prompt: Column | str) -> Column:
    """The segment without the prompt it repeats: if the beginning of the normalized prompt (18 to 55 letters) stands in
    it, as many words as the prompt has are taken off its front, unless that left nothing."""
    seg, p = F.trim(F.coalesce(text.col(segment), F.lit(""))), text.normalize(prompt)
    head = F.substring(p, 1, 55)
    said = F.filter(F.split(seg, r"\s+"), lambda w: w != "")
    n = F.size(text.words(p))
    rest = F.array_join(F.slice(said, n + 1, F.greatest(F.lit(1), F.size(said))), " ")
    return F.when((p != "") & F.contains(text.normalize(seg), head) & (F.size(said) > n), rest).otherwise(seg)


def engine_status(attempts: DataFrame, engines: list[str]) -> DataFrame:
    """engine, tried, found, failed, confidence, available: how the engines did over ``attempts`` (engine, confidence,
    found, and a message where one failed); engines that were never tried are listed too."""
    known = attempts.sparkSession.createDataFrame([(e,) for e in engines], "engine string")
    seen = attempts.groupBy("engine").agg(
        F.count("*").alias("tried"), F.sum(F.col("found").cast("int")).alias("found"), F.sum((F.coalesce("message", F.lit("")) != "").cast("int")).alias("failed"),
        F.round(F.avg(F.when(F.col("found"), F.col("confidence"))) + 1e-9, 2).alias("confidence"),
    )
    out = known.join(seen, "engine", "left").fillna({"tried": 0, "found": 0, "failed": 0, "confidence": 0.0})
    return out.withColumn("available", F.col("tried") > F.col("failed"))


def safe_gate(filled: Column, direct: Column, segmentation: Column, questions: Column, has_raw: Column) -> Column:
    """Why a session's answers must not be graded, or null."""
    return F.when(filled == 0, "no answers").when((direct == 0) & (segmentation < 0.48) & (filled <= 1) & (questions > 1) & has_raw, "uncertain segmentation")


def segment_document(raw: str | None, questions: list[tuple[str, str]]) -> tuple[dict[str, str], str, float]:
    """Segments of a document by question (id, prompt), how they were found, and the confidence.

    A question's marker is the first of its id, ``p n``, ``pregunta n``, ``item n`` or ``n`` with a mark; else
    its prompt's beginning is looked for.  Two markers or more part the text; fewer leave numbered lines, and
    else the whole goes to the first question."""
    if not raw or not raw.strip():
        return {q: "" for q, _ in questions}, "empty", 0.0
    body = re.sub(r"(?m)^(\s*\d{1,2})\s+(?=\S)", r"\1. ", raw)
    body = re.sub(r"(?i)\bpreg\.?\s*(\d+)", r"Pregunta \1", body)
    marks, anchored = [], False
    for qid, prompt in questions:
        n = re.search(r"\d+", qid)
        shapes = [rf"\b{re.escape(qid)}\b"]
        if n:
            shapes += [rf"\bp\s*{n[0]}\b", rf"\bpregunta\s*{n[0]}\b", rf"\bitem\s*{n[0]}\b", rf"(?m)^\s*{n[0]}\s*[).:-]"]
        hit = next((m for s in shapes if (m := re.search(s, body, re.IGNORECASE))), None)
        if hit:
            marks.append((hit.start(), hit.end(), qid))
            continue
        norm, p = text.normalize_py(body), text.normalize_py(prompt)
        for head in (p[:60], p[:40], " ".join(p.split()[:6])):
            if len(head) >= 18 and (at := norm.find(head)) >= 0:
                start = int(at / max(1, len(norm)) * len(body))
                marks.append((start, min(len(body), start + len(head)), qid))
                anchored = True
                break
    marks.sort()
    out = {q: "" for q, _ in questions}
    if len(marks) >= 2:
        for (_, end, qid), after in zip(marks, [*(m[0] for m in marks[1:]), len(body)]):
            out[qid] = re.sub(r"^[\s).:\-–]+", "", body[end:after]).strip()
        filled = sum(1 for v in out.values() if v)
        return out, "markers", min(0.92, 0.40 + 0.08 * filled + 0.10 * anchored)
    parts = [x.strip() for x in re.split(r"(?m)^\s*\d{1,2}\s*[).:-]\s*", body) if x.strip()]
    if len(parts) >= 2:
        for (qid, _), part in zip(questions, parts):
            out[qid] = part
        return out, "numbered", 0.70
    if questions:
        out[questions[0][0]] = body.strip()
    return out, "whole", 0.25


def segment_documents(documents: DataFrame, key: str, questions: list[tuple[str, str]]) -> DataFrame:
    """key, question_id, segment, mode, confidence for each document (text) and question of the rubric."""
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, q, s, mode, c) for k, t in zip(batch[key], batch["text"]) for found, mode, c in [segment_document(t, questions)] for q, s in found.items()]
            yield pd.DataFrame(rows, columns=[key, "question_id", "segment", "mode", "confidence"])

    return documents.select(key, "text").mapInPandas(run, f"{key} {kind}, question_id string, segment string, mode string, confidence double")
