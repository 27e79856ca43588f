"""Rubrics: nested JSON documents and flat tables, their questions and their targets.

A rubric has one row for each question; targets are what an answer is compared with.  Both are small next to
the answers, whatever their number, and are joined on the question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.functions import lexicon, text
from marklake.sources import xlsx

CRITERION = "struct<concept: string, weight: double, semantic_variants: array<string>, accepted_values: array<string>>"
PAIR = "struct<prompt_value: string, correct_match: string, weight: double>"


def _document_schema() -> str:
    fields = ", ".join(f"{name}: {kind}" for name, kind in (
        ("id", "string"), ("item_type", "string"), ("max_score", "double"), ("prompt", "string"), ("accepted_answers", "array<string>"), ("accepted_concepts", "array<string>"),
        ("constraints", "struct<required_number_of_items: int>"), ("criteria", f"array<{CRITERION}>"), ("pairs", f"array<{PAIR}>"), ("indispensable_element", "string"),
        ("equivalent_examples", "array<string>"), ("evaluation_observations", "string"),
    ))
    return f"name string, title string, exam_id string, total_score double, language string, domain string, questions array<struct<{fields}>>"


DOCUMENT = _document_schema()

# Headers of rubric tables by field; a header in two lists belongs to the first.
HEADERS = {
    "id": ["pregunta", "id", "item", "pregunta_id", "question"],
    "item_type": ["tipodepregunta", "tipo", "tipo_pregunta", "item_type", "tipoitem"],
    "max_score": ["puntaje", "puntaje_maximo", "max_score", "puntos"],
    "answers": ["ideasesperadas", "ideasclave", "ideas_clave", "respuestas", "respuesta", "accepted_answers", "respuesta_esperada"],
    "criteria": ["criterios", "criteria", "conceptos"],
    "variants": ["variantes", "sinonimos", "variants"],
    "prompt": ["enunciado", "prompt", "texto"],
    "indispensable_element": ["elementoindispensable", "elemento_indispensable", "indispensable"],
    "equivalent_examples": ["ejemplosequivalentes", "ejemplos_equivalentes", "equivalentes"],
    "evaluation_observations": ["observaciones", "observaciones_evaluacion", "observations"],
    "required": ["required_items", "cantidad_requerida", "items_requeridos"],
}


def item_type(c: Column | str) -> Column:
    """The canonical item type; what is not known passes through, empty is open."""
    t = F.replace(text.normalize(c), F.lit(" "), F.lit("_"))
    names = F.create_map(*[F.lit(x) for family, known in lexicon.ITEM_TYPES.items() for name in known for x in (name, family)])
    return F.coalesce(F.element_at(names, t), F.nullif(t, F.lit("")), F.lit("criteria"))


def type_label(c: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in lexicon.TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, text.col(c)), text.col(c), F.lit("Question"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON rubrics, one row each, with file_name; unreadable files have no questions."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return docs.withColumn("file_name", F.col("_metadata.file_name"))


def catalog(spark: SparkSession, *folders: str) -> DataFrame:
    """Rubric files of several folders: file_name and label, the first folder's where a name repeats."""
    found = None
    for place, folder in enumerate(folders):
        part = read_documents(spark, folder).filter(F.col("questions").isNotNull()).withColumn("place", F.lit(place))
        found = part if found is None else found.unionByName(part)
    first = F.row_number().over(Window.partitionBy("file_name").orderBy("place"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    label = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), stem)
    return found.withColumn("n", first).filter("n = 1").select("file_name", label.alias("label")).orderBy(F.lower("label"), "file_name")


def select_rubric(documents: DataFrame, name: str | None = None) -> DataFrame:
    """The rubric of a file name, or the first.  A name that is not in the catalog, and a catalog without rubrics, are
    errors."""
    found = documents.filter(F.col("questions").isNotNull())
    found = (found.filter(F.col("file_name") == name) if name else found).orderBy("file_name").limit(1)
    if found.isEmpty():
        raise LookupError(f"there is no rubric named {name!r}" if name else "there are no rubrics")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """The questions of an uploaded rubric, by the suffix of its name: .json, .xlsx or .csv (a flat table)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return questions(select_rubric(read_documents(spark, path)))
    if kind == "xlsx":
        return from_table(xlsx.read(spark, path))
    if kind == "csv":
        return from_table(spark.read.option("header", True).csv(path))
    raise ValueError("a rubric is a .json, .xlsx or .csv file")


def questions(documents: DataFrame) -> DataFrame:
    """One row for each question, with its place and canonical type."""
    q = documents.select(F.posexplode("questions").alias("q_pos", "q")).select("q_pos", "q.*")
    kind = item_type("item_type")
    known = [x for family in lexicon.ITEM_TYPES for x in (family, *lexicon.ENUMERATIONS)]
    return q.withColumn("item_type", F.when(~kind.isin(known), "criteria").otherwise(kind))


def from_table(table: DataFrame) -> DataFrame:
    """Questions out of a flat rubric table, whose headers may go by many names; rows without an id go."""
    found: dict[str, str] = {}
    taken: set[str] = set()
    canonical = {}
    for c in table.columns:
        canonical[text.header_py(c)] = c
    for field, names in HEADERS.items():
        for n in names:
            if n in canonical and canonical[n] not in taken:
                found[field] = canonical[n]
                taken.add(canonical[n])
                break
    if "id" not in found:
        raise ValueError("a rubric table needs a question column")

    def cell(field: str) -> Column:
        return F.col(f"`{found[field]}`").cast("string") if field in found else F.lit(None).cast("string")

    kind = item_type(cell("item_type"))
    score = F.coalesce(cell("max_score").try_cast("double"), F.lit(1.0))
    answers, ideas = text.split_values(cell("answers")), text.split_values(cell("criteria"))
    concepts = F.when(F.size(ideas) > 0, ideas).otherwise(answers)
    variants, examples = text.split_values(cell("variants")), text.split_values(cell("equivalent_examples"))
    criteria = F.transform(
        concepts,
        lambda c: F.struct(c.alias("concept"), (score / F.greatest(F.size(concepts), F.lit(1))).alias("weight"), variants.alias("semantic_variants"), F.array(c).alias("accepted_values")),
    )
    pairs = F.transform(
        F.filter(answers, lambda a: F.contains(a, F.lit(":"))),
        lambda a: F.struct(
            F.trim(F.substring_index(a, ":", 1)).alias("prompt_value"), F.trim(F.substring(a, F.instr(a, ":") + 1, F.length(a))).alias("correct_match"),
            (score / F.greatest(F.size(answers), F.lit(1))).alias("weight"),
        ),
    )
    is_open, is_match = kind == "criteria", kind == "classification_matching"
    accepted = F.array_union(answers, examples)
    required = cell("required").try_cast("double").cast("int")
    rows = table.filter(F.trim(F.coalesce(cell("id"), F.lit(""))) != "")
    return rows.select(
        F.monotonically_increasing_id().alias("q_pos"), F.trim(cell("id")).alias("id"), kind.alias("item_type"), score.alias("max_score"), cell("prompt").alias("prompt"),
        F.when(~is_open & ~is_match, accepted).alias("accepted_answers"), F.when(kind.isin(lexicon.ENUMERATIONS), accepted).alias("accepted_concepts"),
        F.struct(required.alias("required_number_of_items")).alias("constraints"), F.when(is_open, criteria).alias("criteria"), F.when(is_match, pairs).alias("pairs"),
        cell("indispensable_element").alias("indispensable_element"), examples.alias("equivalent_examples"), cell("evaluation_observations").alias("evaluation_observations"),
    )


def integrity_issues(q: DataFrame) -> DataFrame:
    """id and issue for each thing that is wrong with a rubric's questions."""
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    copies = F.count("*").over(Window.partitionBy("id"))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    is_open, is_match = F.col("item_type") == "criteria", F.col("item_type") == "classification_matching"
    checks = [
        (blank, "no id"), (~blank & (F.col("copies") > 1), "repeated id"), (F.coalesce(F.col("max_score"), F.lit(0.0)) <= 0, "max_score is not positive"),
        (is_open & none("criteria") & none("accepted_answers"), "open question without criteria and answers"),
        (~is_open & ~is_match & none("accepted_answers") & none("accepted_concepts"), "closed question without accepted answers"), (is_match & none("pairs"), "matching question without pairs"),
    ]
    issues = F.array_compact(F.array(*[F.when(bad, F.lit(said)) for bad, said in checks]))
    return q.withColumn("copies", copies).select("id", F.explode(issues).alias("issue"))


def targets(q: DataFrame) -> DataFrame:
    """question_id, role, target_pos, concept, variant_pos, variant, weight of everything an answer is compared
    with, and its normalized form, stems and expansions."""

    def role(name: str, items: Column, concept, variants, weight) -> DataFrame:
        t = q.select(F.col("id").alias("question_id"), F.lit(name).alias("role"), F.posexplode(items).alias("target_pos", "x"))
        return t.select("question_id", "role", "target_pos", concept.alias("concept"), weight.cast("double").alias("weight"), F.posexplode(variants).alias("variant_pos", "variant"))

    x, one, empty = F.col("x"), F.lit(1.0), F.expr("array()").cast("array<string>")
    own = F.array(x)
    criteria = F.array_distinct(F.concat(F.array("x.concept"), F.coalesce("x.semantic_variants", empty), F.coalesce("x.accepted_values", empty)))
    support = F.concat(F.array("indispensable_element"), F.coalesce("equivalent_examples", empty))
    out = role("accepted", F.col("accepted_answers"), x, own, one)
    for part in (
        role("item", F.coalesce("accepted_concepts", "accepted_answers"), x, own, one), role("criterion", F.col("criteria"), F.col("x.concept"), criteria, F.col("x.weight")),
        role("left", F.col("pairs"), F.col("x.prompt_value"), F.array("x.prompt_value"), F.col("x.weight")), role("right", F.col("pairs"), F.col("x.correct_match"), F.array("x.correct_match"), F.col("x.weight")),
        role("support", F.filter(support, lambda s: F.trim(s) != ""), x, own, one),
    ):
        out = out.unionByName(part)
    out = out.withColumn("variant_norm", text.normalize("variant")).filter("variant_norm <> ''")
    return out.withColumn("variant_stems", F.array_distinct(text.stems(text.tokens("variant_norm"))))


def expansions_of(spark: SparkSession, t: DataFrame) -> DataFrame:
    """The targets with ``expansions``: what stands for the variant, itself first in none but the alphabet.

    The lexicon's edges both ways, and those of the single words, are joined as a table."""
    forward = lexicon.edges(spark, lexicon.SYNONYMS, "term", "other")
    groups = [(x, y) for key, values in lexicon.SYNONYMS.items() for x in [key, *values] for y in [key, *values]]
    full = spark.createDataFrame(sorted(set(groups)), "term string, other string")
    norms = t.select("variant_norm").distinct()
    whole = norms.join(full, F.col("variant_norm") == F.col("term")).select("variant_norm", "other")
    single = norms.select("variant_norm", F.explode(text.tokens("variant_norm")).alias("term")).join(forward, "term").select("variant_norm", "other")
    every = whole.unionByName(single).unionByName(norms.select("variant_norm", F.col("variant_norm").alias("other")))
    return t.join(every.groupBy("variant_norm").agg(F.array_sort(F.collect_set("other")).alias("expansions")), "variant_norm")
