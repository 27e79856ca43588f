"""Contradictions, relations, error types and the diagnosis of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import lexicon, text


def wrong_relation(norm: Column, concept: Column, bad: Column, window: int = 7) -> Column:
    """Whether the answer calls the concept what contradicts it; saying that it isn't does not count."""

    def says(*parts) -> Column:
        return F.contains(norm, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    denied = says("no es ", bad) | says("no son ", bad) | says(concept, " no corresponde a ", bad) | says(concept, " no funciona como ", bad)
    said = says("es un ", bad) | says("es una ", bad) | says("son ", bad)
    for link in (" es ", " son ", " corresponde a ", " corresponde al ", " funciona como ", " se define como ", " consiste en "):
        said = said | says(concept, link, bad)
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    defines = F.lit(False)
    for verb in (" es ", " son ", " corresponde ", " funciona como ", " se define ", " consiste "):
        defines = defines | F.contains(padded, F.lit(verb))

    def places(phrase: Column) -> Column:
        said, p = text.words(norm), text.words(phrase)
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(said)))
        return F.filter(at, lambda i: F.slice(said, i, F.greatest(F.lit(1), F.size(p))) == p)

    close = F.exists(places(concept), lambda c: F.exists(places(bad), lambda b: F.abs(c - b) <= window))
    there = (norm != "") & (concept != "") & (bad != "")
    return there & ~denied & (said | defines & close)


def contradictions(spark: SparkSession, answers: DataFrame, targets: DataFrame) -> DataFrame:
    """question_id, answer_norm, concept, wrong of each contradiction.  The lexicon is joined as a table, by
    the terms that stand for a concept."""
    wrong = lexicon.edges(spark, {t: w for t in sorted({x for k in lexicon.CONTRADICTIONS for x in lexicon.expansions(k)}) if (w := lexicon.contradictions(t))}, "term", "wrong")
    concepts = targets.filter("role in ('criterion', 'accepted', 'item')").select("question_id", "concept").distinct().withColumn("norm", text.normalize("concept"))
    words = lexicon.edges(spark, {k: lexicon.expansions(k) for k in sorted({*lexicon.SYNONYMS, *lexicon.CONTRADICTIONS})}, "norm", "term")
    terms = concepts.withColumn("term", F.col("norm")).unionByName(concepts.join(words, "norm")).distinct()
    risky = terms.join(wrong, "term").select("question_id", "concept", "term", "wrong")
    pairs = answers.join(risky, "question_id").filter(F.contains("answer_norm", "term") & F.contains("answer_norm", "wrong"))
    return pairs.filter(wrong_relation(F.col("answer_norm"), F.col("term"), F.col("wrong"))).select("question_id", "answer_norm", "concept", "wrong").distinct()


def error_type(norm: Column, n_tokens: Column, profile: Column, concepts: Column, present: Column, relations: Column, contradicted: Column) -> Column:
    """struct(error, severity); counts of concepts, present ones, relations and contradictions."""

    def out(error: str, severity: str) -> Column:
        return F.struct(F.lit(error).alias("error"), F.lit(severity).alias("severity"))

    partly = (present > 0) & (present < concepts)
    return (
        F.when(norm == "", out("empty", "high"))
        .when(norm.isin(lexicon.VAGUE) | (n_tokens <= 1), out("vague", "medium"))
        .when(contradicted > 0, out("contradiction", "high"))
        .when((concepts > 0) & (present == 0), out("off focus", "high"))
        .when(partly & profile.isin("brief", "short"), out("brief and partial", "low"))
        .when(partly, out("incomplete", "medium"))
        .when((concepts >= 2) & (present >= 2) & (relations == 0) & (profile == "developed"), out("weak relation", "medium"))
        .otherwise(out("none", "low"))
    )


def feedback(error: Column, missing: Column, relations: Column, profile: Column) -> Column:
    """A sentence for the teacher; ``missing`` and ``relations`` are arrays."""
    return (
        F.when(error == "empty", "Ask for an answer; there is nothing to grade.")
        .when(error == "vague", "Ask for more precise concepts; the answer is too general.")
        .when(error == "contradiction", "Check by hand: it may confuse concepts.")
        .when(error == "off focus", "Go over the core of the question; no expected idea was found.")
        .when(error == "brief and partial", "The core is right; ask for more where the rubric wants an explanation.")
        .when(error == "incomplete", F.concat(F.lit("Missing: "), F.array_join(F.slice(missing, 1, 4), ", "), F.lit(".")))
        .when(error == "weak relation", "Ask to connect the concepts by cause, function or consequence.")
        .when(F.size(relations) > 0, F.concat(F.lit("Consistent; relations: "), F.array_join(F.slice(relations, 1, 4), ", "), F.lit(".")))
        .when(profile.isin("brief", "short"), "Acceptable but brief.")
        .otherwise("In line with the criteria.")
    )


def diagnosis(scored: DataFrame) -> DataFrame:
    """Scored answers with coverage, error, severity and what the decision rests on."""
    n_tokens = F.size(text.tokens("answer_norm"))
    e = error_type(F.col("answer_norm"), n_tokens, F.col("profile"), F.col("concepts"), F.col("matched"), F.col("relations"), F.col("contradictions"))
    coverage = F.when(F.col("concepts") > 0, F.round(F.col("matched") / F.col("concepts"), 2)).otherwise(0.0)
    d = scored.withColumn("e", e).withColumn("coverage", coverage)
    basis = F.format_string("coverage=%.2f; relations=%d; contradictions=%d; profile=%s", "coverage", "relations", "contradictions", "profile")
    return d.select(*scored.columns, "coverage", F.col("e.error").alias("error_type"), F.col("e.severity").alias("severity"), basis.alias("basis"))
