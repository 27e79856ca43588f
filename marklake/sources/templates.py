"""Sample tables that show what a rubric and a table of answers look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUBRIC = [
    ("P1", "Pregunta abierta", 4.0, "gravedad; orbita; masa", "Explica por qué los planetas giran alrededor del Sol"),
    ("P2", "Verdadero/Falso", 1.0, "Verdadero", "El Sol es una estrella"),
    ("P3", "Completar", 2.0, "Vía Láctea", "Nuestra galaxia se llama"),
    ("P4", "Enumerar", 3.0, "Mercurio; Venus; Tierra; Marte", "Nombra los planetas rocosos"),
    ("P5", "Relacionar", 4.0, "Júpiter: gigante gaseoso; Marte: planeta rojo; Saturno: anillos; Luna: satélite", "Relaciona cada astro"),
]
RESPONSES = [
    ("A01", "Ana", "La gravedad del Sol, por su masa, mantiene a los planetas en órbita a su alrededor", "Verdadero", "Vía Láctea", "Tierra, Marte", "Júpiter gigante gaseoso; Marte planeta rojo"),
    ("A02", "Beto", "Por la gravedad", "V", "la via lactea", "Mercurio, Venus, Tierra y Marte", "Saturno anillos"),
    ("A03", "Caro", None, "Falso", "Andrómeda", "", "no sé"),
]


def rubric_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBRIC, "Pregunta string, `Tipo de pregunta` string, Puntaje double, `Ideas esperadas` string, Enunciado string")


def responses_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESPONSES, "student_id string, nombre string, P1 string, P2 string, Q3 string, pregunta_4 string, item5 string")
