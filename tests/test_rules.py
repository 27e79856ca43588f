"""Rules on single values, with results worked out by hand."""

from __future__ import annotations

import io
import itertools
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklake.functions import lexicon, text
from marklake.functions.fuzzy import partial_ratio
from marklake.operators import diagnose, insight, ocr, scoring, vision
from marklake.sources import responses, rubric, sinks, templates, xlsx


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    got = values(spark, text.normalize("t"), "  Vía  LÁCTEA! ", None, "a/b_c-d.e", "Ñandú ß", "\t\n")
    assert got == ["via lactea", "", "a/b_c-d.e", "nandu", ""]
    assert got == [text.normalize_py(x) for x in ("  Vía  LÁCTEA! ", None, "a/b_c-d.e", "Ñandú ß", "\t\n")]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normalize_is_idempotent(t):
    once = text.normalize_py(t)
    assert text.normalize_py(once) == once


def test_tokens_stems_profile(spark):
    toks = text.tokens(text.normalize("t"))
    assert values(spark, toks, "La gravedad y las órbitas de un planeta", "no", None) == [["gravedad", "orbitas", "planeta"], [], []]
    assert values(spark, text.stem("t"), "definiciones", "gravedades", "mes", "lentamente") == ["defin", "gravedad", "mes", "lenta"]
    assert [text.stem_py(t) for t in ("definiciones", "gravedades", "mes", "lentamente")] == ["defin", "gravedad", "mes", "lenta"]
    nine = "uno1 dos2 tres3 cuatro4 cinco5 seis6 siete7 ocho8"
    assert values(spark, text.length_profile(toks), "", "sol luna mar", nine, nine + " nueve9") == ["empty", "brief", "short", "developed"]


def test_split_values(spark):
    assert values(spark, text.split_values("t"), "a; b / c | d, e", "Broca:x; Wernicke:y, z", "1) uno\n- dos", "sal y luz", None) == [
        ["a", "b", "c", "d", "e"], ["Broca:x", "Wernicke:y, z"], ["uno", "dos"], ["sal", "luz"], [],
    ]


def test_negation(spark):
    target = F.array(F.lit("estrella"))
    assert values(spark, text.negated(text.normalize("t"), target), "no es una estrella", "es una estrella", "no uno dos tres cuatro estrella", "estrella no", "") == [True, False, False, False, False]


def test_partial_ratio():
    assert partial_ratio("abc", "xxabcxx") == 100.0
    assert partial_ratio("", "abc") == 0.0
    assert partial_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert partial_ratio("gravedad", "la graveda del sol") == pytest.approx(87.5)
    assert partial_ratio("kitten", "sitting") == partial_ratio("sitting", "kitten")


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=8), st.text("abc ", max_size=14))
def test_partial_ratio_against_all_windows(a, b):
    s, t = (a, b) if len(a) <= len(b) else (b, a)

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def best(s, t):
        n = len(s)
        spans = [(max(0, e - n), min(e, len(t))) for e in range(1, len(t) + n)]
        return max((200.0 * lcs(s, t[i:j]) / (n + j - i) for i, j in spans), default=0.0)

    expected = 100.0 if not s and not t else 0.0 if not s else max(best(s, t), best(t, s) if len(s) == len(t) else 0.0)
    assert partial_ratio(a, b) == pytest.approx(expected)


def test_expansions_go_both_ways():
    assert "mente" in lexicon.expansions("pensamiento") and "cognicion" in lexicon.expansions("mente")
    assert lexicon.expansions("xyz") == ["xyz"]
    assert "estrella" in lexicon.contradictions("planeta")


def test_wrong_relation(spark):
    args = (F.lit("estrella"), F.lit("planeta"))
    assert values(spark, diagnose.wrong_relation(text.normalize("t"), *args), "una estrella es un planeta caliente", "la estrella no es planeta", "la estrella ilumina al planeta", "") == [True, False, False, False]


def test_bands(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(insight.level(F.lit(x))) for x in (80.0, 79.99, 60.0, 59.99)] == ["high", "medium", "medium", "low"]
    assert get(insight.level(F.lit("?"))) == "unknown"
    assert get(ocr.state(F.lit(0.88), F.lit(0.70))) == "green"
    assert [get(insight.status(F.lit(x))) for x in (0.82, 0.81, 0.48, 0.47)] == ["accepted", "caution", "caution", "review"]
    assert get(vision.light(F.lit(77.0))) == "yellow"


@pytest.mark.parametrize(
    ("answers", "whole", "expected"),
    [
        ((0.3, 0.39, 0.72, 0.99), 1.0, ("medium", "adequate", "give more explicit criteria or examples")),  # means of 60 percent and 0.6
        ((0.6, 0.7, 0.8), 1.0, ("medium", "adequate", "stable")),  # 0.7
        ((17.6, 41.6, 43.2, 48.0, 49.6), 50.0, ("high", "high performance", "stable")),  # 80 percent
    ],
)
def test_means_on_a_bound(spark, answers, whole, expected):
    """An item for each order of the same answers, whose mean lies on bounds of the rules: all get one verdict."""
    orders = list(itertools.permutations(answers))
    rows = [(i, x, whole, x / whole, "accepted") for i, o in enumerate(orders) for x in o]
    scored = spark.createDataFrame(rows, "item_id int, score double, max_score double, confidence double, status string").coalesce(1)
    got = insight.item_statistics(scored, ["item_id"]).groupBy("item_level", "classification", "suggestion").count().collect()
    assert [tuple(r) for r in got] == [(*expected, len(orders))]


def test_sample_answers(spark):
    """The expected results of the sample tables."""
    q = rubric.from_table(templates.rubric_table(spark))
    wide = templates.responses_table(spark)
    assert rubric.integrity_issues(q).count() == 0 and responses.issues(wide, ["P1", "P2", "P3", "P4", "P5"]) == []
    long = responses.unpivot(wide, ["P1", "P2", "P3", "P4", "P5"])
    assert long.count() == 15
    scored = diagnose.diagnosis(scoring.score_answers(spark, long, q, rubric.targets(q)))
    got = {(r.student_id, r.question_id): r for r in scored.collect()}
    assert len(got) == 15
    for key, score, confidence, status in (
        (("A01", "P2"), 1, 1.0, "accepted"), (("A02", "P2"), 1, 0.9, "accepted"), (("A03", "P2"), 0, 0.9, "accepted"), (("A01", "P3"), 2, 1.0, "accepted"),
        (("A01", "P4"), 1.5, 0.5, "caution"), (("A01", "P5"), 2, 0.5, "caution"), (("A03", "P1"), 0, 0.1, "review"),
    ):
        r = got[key]
        assert (r.score, r.confidence, r.status) == (pytest.approx(score), pytest.approx(confidence), status), key
    assert all(0 <= r.score <= r.max_score for r in got.values())
    assert got["A03", "P1"].error_type == "empty"


def test_table_issues(spark):
    bad = spark.createDataFrame([("a", "b")], "x string, y string")
    found = responses.issues(bad, ["P1"], row_limit=0)
    assert "fewer than three columns" in found and "no column for question P1" in found and "more than 0 rows" in found


def test_rubric_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"name": "One", "questions": [{"id": "P1", "item_type": "differentiation", "max_score": 2, "criteria": [{"concept": "a", "weight": 1}]}]}')
    (tmp_path / "bad.json").write_text("{")
    docs = rubric.read_documents(spark, str(tmp_path))
    assert [r.label for r in rubric.catalog(spark, str(tmp_path)).collect()] == ["One"]
    assert rubric.questions(docs.filter("questions is not null")).first().item_type == "criteria"
    with pytest.raises(LookupError):
        rubric.select_rubric(docs, "../one.json")


def test_workbook(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>P1</t></is></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>'
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><r><t>so</t></r><r><t>l</t></r></si></sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", strings)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    df = xlsx.read(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["id", "unnamed_1", "P1"] and [tuple(r) for r in df.collect()] == [("7", None, "sol")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    sinks.write_sheets({"scores": df}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).first().t == "a"
    sinks.save_session(df, str(tmp_path / "s"), "0123456789ab")
    assert sinks.read_session(spark, str(tmp_path / "s"), "0123456789ab").count() == 1
    with pytest.raises(ValueError):
        sinks.save_session(df, str(tmp_path / "s"), "../x")
    assert sinks.file_slug("Rúbrica 1!") == "rubrica_1"


def test_segmenter():
    q = [("P1", "Explica la gravedad de los planetas"), ("P2", "")]
    assert ocr.segment_document("", q)[1:] == ("empty", 0.0)
    found, mode, confidence = ocr.segment_document("P1: la masa\nPregunta 2) la luz", q)
    assert found == {"P1": "la masa", "P2": "la luz"} and mode == "markers" and confidence == pytest.approx(0.56)
    assert ocr.segment_document("sin marcas", q) == ({"P1": "sin marcas", "P2": ""}, "whole", 0.25)


def test_response_text(spark):
    got = values(spark, ocr.response_text("t"), '{"pages": [{"markdown": "a"}, {"text": "b"}]}', '{"text": "c"}', "{}", None)
    assert got == ["a\n\nb", "c", "", ""]


def test_pixels(spark):
    rows = [("x", 4, 4, 3, bytearray(b"\xff" * 48)), ("y", 4, 4, 1, bytearray(range(0, 160, 10)))]
    got = vision.pixel_measures(spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary")).orderBy("origin").collect()
    assert got[0].blur == pytest.approx(0) and got[0].bright_ratio == 1.0 and got[1].brightness == pytest.approx(75.0)


def test_sql_names(spark):
    from marklake.functions.register import register

    register(spark)
    r = spark.sql("SELECT normalize_text(' Vía  LÁCTEA! ') AS n, semantic_tokens('La gravedad y el Sol') AS t, partial_ratio('abcd', 'abxd') AS p").first()
    assert (r.n, r.t, r.p) == ("via lactea", ["gravedad", "sol"], pytest.approx(75.0))
    got = spark.sql("SELECT * FROM segment_document('P1: uno\\nP2: dos', array('P1', 'P2'))").collect()
    assert {x.question_id: x.segment for x in got} == {"P1": "uno", "P2": "dos"}


def test_capture_hooks(spark):
    from marklake.operators import capture

    files = spark.createDataFrame([("a.png", bytearray(b"x")), ("b.png", bytearray(b""))], "path string, content binary")

    def engine(content):
        if not content:
            raise ValueError("nothing")
        return "text", 0.9

    got = {r.path: r for r in capture.recognize(files, "local", engine).collect()}
    assert got["a.png"].text == "text" and got["b.png"].message.startswith("ValueError")
    vectors = capture.encode(spark.createDataFrame([("a",), ("a",), ("",), ("bb",)], "norm string"), lambda texts: [[len(t), 1] for t in texts]).collect()
    assert {r.norm: r.vector for r in vectors} == {"a": [1.0, 1.0], "bb": [2.0, 1.0]}


def test_sessions_once(spark):
    from marklake.streaming import sessions

    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "token string, at int")
    assert sorted((r.token, r["at"]) for r in sessions.first_use(df, "token", "at").collect()) == [("a", 1), ("b", 5)]


def test_stem_takes_the_first_suffix_that_fits(spark):
    made = [stem + a + b for stem in ("casa", "gravi", "abcdef") for a in ("", *lexicon.SUFFIXES) for b in ("", *lexicon.SUFFIXES)]
    assert values(spark, text.stem("t"), *made) == [text.stem_py(t) for t in made]


def test_prompt_is_stripped(spark):
    rows = [("What is a cell membrane exactly? It is the border of a cell", "What is a cell membrane exactly?"), ("It is the border", "What is it"), ("what is it", "What is it"), (None, "x"), ("a b", None), ("", "")]
    got = spark.createDataFrame(rows, "s string, p string").select(ocr.strip_prompt("s", "p").alias("o")).collect()
    assert [r.o for r in got] == ["It is the border of a cell", "It is the border", "what is it", "", "a b", ""]


def test_engine_status(spark):
    rows = [("a", 0.5, True, None), ("a", 0.0, False, "IOError: x"), ("b", 0.0, False, "no key")]
    got = {r.engine: (r.tried, r.found, r.failed, r.confidence, r.available) for r in ocr.engine_status(spark.createDataFrame(rows, "engine string, confidence double, found boolean, message string"), ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 1, 1, 0.5, True), "b": (1, 0, 1, 0.0, False), "c": (0, 0, 0, 0.0, False)}


def test_uploaded_rubric_by_suffix(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Pregunta,Tipo de pregunta,Puntaje,Ideas esperadas\nP1,Completar,2,rojo; azul\n")
    assert [tuple(r) for r in rubric.load(spark, str(tmp_path / "r.csv")).select("id", "item_type", "max_score", "accepted_answers").collect()] == [("P1", "completion", 2.0, ["rojo", "azul"])]
    (tmp_path / "r.json").write_text('{"name": "R", "questions": [{"id": "P7", "item_type": "V/F", "accepted_answers": ["V"]}]}')
    assert [r.id for r in rubric.load(spark, str(tmp_path / "r.json")).collect()] == ["P7"]
    (tmp_path / "bad.json").write_text("[1, 2")
    for name, error in (("bad.json", LookupError), ("r.txt", ValueError)):
        with pytest.raises(error):
            rubric.load(spark, str(tmp_path / name))


def test_workbooks_have_all_their_sheets(spark, sf_dir, tmp_path):
    from marklake.operators import report
    from marklake.plans import grading
    from marklake.sources import sinks

    graded = grading.graded(spark, sf_dir)
    batch = report.sheets(graded, "R", "r.json", "a.xlsx", ["1", "2"], {"model": "m"})
    assert len(batch) == 13 and len(report.traceability(graded).columns) == 14 and batch["summary"].columns[0] == "rubric" and len(batch["summary"].columns) == 11
    session = graded.select("student_id").distinct().selectExpr("student_id", "'c' course", "'e' exam", "'d' date", "'raw' raw_text", "'edited' edited_text")
    one = report.session_sheets(graded, session, session.selectExpr("student_id", "1 page", "'hosted' engine"), ["1", "2"], "hosted")
    assert len(one) == 8
    small = {k: v for k, v in (batch | {f"session_{k}": v for k, v in one.items()}).items() if k in ("summary", "interpretation", "robustness", "embeddings", "validation", "types", "session_summary", "session_text")}
    sinks.write_sheets(small, str(tmp_path), "csv")
    for k in small:
        assert spark.read.option("header", True).csv(f"{tmp_path}/{k}").columns == small[k].columns
    assert batch["validation"].first().encoder_model == "m" and one["feedback"].filter("cognitive_level is null").count() == 0
    people = graded.select("student_id").distinct().count()
    assert batch["scores"].count() == people == one["summary"].count() and batch["confidence"].count() == people
