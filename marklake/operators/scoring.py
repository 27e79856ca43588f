"""Scores of answers by the family of their question.

Answers are folded by (question, normalized text) before anything is compared, and the evidence table is the
only place with a Python stage; the scores are aggregates over it, joined back to all answers.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.functions import lexicon, text
from marklake.operators import diagnose
from marklake.operators.insight import status
from marklake.operators.match import answers_view, decide, evidence
from marklake.sources.rubric import expansions_of

OPEN, CLOSED, MATCHING = (68, 58), (80, 66), (65, 58)
KEY = ["question_id", "answer_norm"]


def clamp(c: Column, low: float, high) -> Column:
    return F.greatest(F.lit(float(low)), F.least(high if isinstance(high, Column) else F.lit(float(high)), c))


def gate(norm: Column, n_tokens: Column, profile: Column, n_concepts: Column, n_relations: Column) -> Column:
    """struct(partial, inference, relation, level): how far an answer of this length is trusted."""
    vague = norm.isin(lexicon.VAGUE) | (norm == "")
    bands = [(3, 0.20, 0.00, 0.25, "very brief"), (6, 0.40, 0.15, 0.45, "brief"), (10, 0.65, 0.45, 0.70, "sufficient"), (None, 0.92, 0.85, 0.90, "developed")]

    def pick(i: int) -> Column:
        out = None
        for band in bands[:-1]:
            out = F.when(n_tokens <= band[0], band[i]) if out is None else out.when(n_tokens <= band[0], band[i])
        return out.otherwise(bands[-1][i])

    one, two, rel = (F.when(c, 1.0).otherwise(0.0) for c in (n_concepts >= 1, n_concepts >= 2, n_relations >= 1))
    full = (profile == "developed") & ((n_concepts >= 1) | (n_relations >= 1))
    values = []
    for name, i, adds, least in (("partial", 1, (0.08, 0.08, 0.05), 0.95), ("inference", 2, (0.08, 0.12, 0.12), 0.90), ("relation", 3, (0.05, 0.08, 0.10), 0.90)):
        v = pick(i) + one * adds[0] + two * adds[1] + rel * adds[2]
        v = F.when(full, F.greatest(v, F.lit(least))).otherwise(v)
        values.append(F.when(vague, 0.0).otherwise(F.round(clamp(v, 0, 1), 3)).alias(name))
    return F.struct(*values, F.when(vague, "no evidence").otherwise(pick(4)).alias("level"))


def partial_factor(score: Column, profile: Column, vague: Column, embedding: Column | None = None) -> Column:
    """The share of a criterion's weight that evidence below the threshold earns."""
    dev, okay = profile == "developed", profile.isin("short", "developed")
    emb = F.lit(False) if embedding is None else embedding
    return (
        F.when(vague, 0.0)
        .when(score >= 66, F.when(dev, 0.75).otherwise(0.62))
        .when(score >= 60, F.when(okay, 0.62).otherwise(0.45))
        .when(score >= 54, F.when(dev, 0.48).otherwise(0.32))
        .when(score >= 48, F.when(dev, 0.32).otherwise(0.0))
        .when((score >= 46) & emb & dev, 0.30)
        .otherwise(0.0)
    )


def inference_bonus(matched: Column, partial: Column, relations: Column, contradictions: Column, profile: Column, gate_inference: Column, level: Column) -> Column:
    units = matched + F.lit(0.55) * partial
    relation = F.when((relations >= 1) & (units >= 1), 0.12).otherwise(0.0)
    theme = F.when((profile == "developed") & (units >= 1.1), 0.10).when((profile == "short") & (units >= 1.5), 0.06).otherwise(0.0)
    none = (contradictions > 0) | level.isin("very brief", "no evidence")
    return F.when(none, 0.0).otherwise(F.least(F.lit(0.22), relation + theme) * gate_inference)


def relation_bonus(concepts: Column, relations: Column, n_words: Column) -> Column:
    return F.when(concepts < 2, 0.0).when(relations > 0, F.least(F.lit(0.20), F.lit(0.07) * relations)).when(n_words >= 8, 0.05).otherwise(0.0)


def support_bonus(hit: Column, best: Column, profile: Column) -> Column:
    return F.when(hit, 0.18).when(best >= 60, 0.10).when((best >= 54) & (profile == "developed"), 0.06).otherwise(0.0)


def cognitive_level(share: Column, coverage: Column, relations: Column, profile: Column, confidence: Column) -> Column:
    return (
        F.when(share <= 0.05, "E0")
        .when((share < 0.40) | (coverage < 0.30), "E1")
        .when(share < 0.70, "E2")
        .when((share < 0.90) | (relations == 0), "E3")
        .when((profile == "developed") & (confidence >= 0.75), "E4")
        .otherwise("E3")
    )


def raw_weight(place: Column, concept_norm: Column, prompt_norm: Column) -> Column:
    return (
        F.lit(1.0)
        + F.when(place == 0, 0.25).otherwise(0.0)
        + F.when((concept_norm != "") & F.contains(prompt_norm, concept_norm), 0.18).otherwise(0.0)
        + F.when(text.any_phrase(concept_norm, lexicon.CENTRAL), 0.25).otherwise(0.0)
        + F.when(F.size(text.words(concept_norm)) >= 2, 0.08).otherwise(0.0)
    )


def criterion_weights(criteria: DataFrame) -> DataFrame:
    """``criteria`` (question_id, target_pos, concept, prompt) with weights that add up to 1 in a question."""
    raw = raw_weight(F.col("target_pos"), text.normalize("concept"), text.normalize("prompt"))
    c = criteria.withColumn("raw", raw)
    return c.withColumn("share", F.col("raw") / F.sum("raw").over(Window.partitionBy("question_id"))).drop("raw")


def true_false(norm: Column, accepted: Column) -> Column:
    """struct(ratio, confidence) against normalized accepted answers."""
    first = F.coalesce(F.get(accepted, F.lit(0)), F.lit(""))
    initial = (F.size(accepted) > 0) & (F.substring(norm, 1, 1) == F.substring(first, 1, 1)) & (norm != "")
    exact = F.coalesce(F.array_contains(accepted, norm), F.lit(False))
    ratio = F.when(exact | initial, 1.0).otherwise(0.0)
    confidence = F.when(exact, 1.0).when(initial | (norm != ""), 0.9).otherwise(0.2)
    return F.struct(ratio.alias("ratio"), confidence.alias("confidence"))


def enumeration(hits: Column, required: Column) -> Column:
    return F.least(hits, required) / F.greatest(required, F.lit(1))


def score_answers(spark: SparkSession, answers: DataFrame, questions: DataFrame, targets: DataFrame) -> DataFrame:
    """student_id, row_no, question_id, item_type, score, max_score, confidence, status, the counts behind them
    and the concepts that are missing for each row of ``answers`` (student_id, row_no, question_id, answer)."""
    q = questions.select(F.col("id").alias("question_id"), "item_type", "max_score", "prompt", "accepted_answers", F.col("constraints.required_number_of_items").alias("required"), F.size(F.coalesce("criteria", F.expr("array()"))).alias("n_criteria"))
    known = answers_view(answers.select("question_id", "answer")).select(*KEY, "tokens", "stems", "profile").dropDuplicates(KEY).join(q, "question_id")
    ev = evidence(known.join(expansions_of(spark, targets), "question_id"))
    by = [*KEY, "role", "target_pos", "concept"]

    limits = F.when(F.col("role") == "accepted", decide(*CLOSED)).when(F.col("role").isin("left", "right"), decide(*MATCHING)).otherwise(decide(*OPEN))
    # One row for each target: all the families below read this, so the evidence is computed once.
    best = ev.withColumn("d", limits).groupBy(*by).agg(F.max("weight").alias("weight"), F.bool_or("d.ok").alias("ok"), F.max("d.score").alias("best"), F.bool_or("negated").alias("negated"))
    best = best.persist(StorageLevel.MEMORY_AND_DISK)

    def of(role: str, value: Column) -> Column:
        return F.when(F.col("role") == role, value)

    one = F.when(F.col("ok"), 1).otherwise(0)
    flat = best.groupBy(*KEY).agg(
        F.min(F.when(F.col("ok"), of("accepted", F.struct("target_pos", "best")))).alias("hit"), F.max(of("accepted", F.col("best"))).alias("any"),
        F.countDistinct(F.when(F.col("ok"), of("item", F.col("concept")))).alias("hits"), F.count(of("item", F.lit(1))).alias("n_items"),
        F.bool_or(of("support", F.col("ok"))).alias("support_hit"), F.max(of("support", F.col("best"))).alias("support_best"),
    )
    flat = flat.withColumn("closed_ratio", F.when(F.col("hit").isNotNull(), 1.0).otherwise(0.0)).withColumn("closed_confidence", F.coalesce("hit.best", "any") / F.lit(100.0)).drop("hit", "any")
    sides = best.filter("role in ('left', 'right')").groupBy(*KEY, "target_pos").agg(F.sum(one).alias("ok"), F.max("weight").alias("weight"))
    paired = sides.groupBy(*KEY).agg(F.sum(F.when(F.col("ok") == 2, F.col("weight")).otherwise(0.0)).alias("pair_weight"))

    wrong = diagnose.contradictions(spark, known.select(*KEY), targets).withColumn("contradicted", F.lit(True))
    crit = best.filter("role = 'criterion'").join(wrong.select(*KEY, "concept", "contradicted").distinct(), [*KEY, "concept"], "left")
    crit = crit.withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    crit = crit.withColumn("best", F.when(F.col("contradicted"), F.least(F.col("best"), F.lit(42))).otherwise(F.col("best"))).withColumn("ok", F.col("ok") & ~F.col("contradicted"))
    shares = criterion_weights(targets.filter("role = 'criterion'").select("question_id", "target_pos", "concept").distinct().join(q.select("question_id", "prompt"), "question_id")).select("question_id", "target_pos", "share")
    crit = crit.join(shares, ["question_id", "target_pos"]).join(known.select(*KEY, "profile", "max_score", "n_criteria", F.size("tokens").alias("n_tokens")), KEY)
    factor = F.when(F.col("ok"), 0.0).otherwise(partial_factor(F.col("best"), F.col("profile"), F.col("negated") | F.col("answer_norm").isin(lexicon.VAGUE)))
    weight = F.when(F.col("n_criteria") > 1, F.col("share") * F.col("max_score")).otherwise(F.coalesce("weight", F.col("max_score")))
    shown = F.when(F.col("ok") & F.col("profile").isin("brief", "short"), F.greatest(F.col("best") / F.lit(100.0), F.lit(0.72))).otherwise(F.col("best") / F.lit(100.0))
    crit = crit.withColumn("factor", factor).withColumn("w", weight).withColumn("shown", shown)
    per = crit.groupBy(*KEY).agg(
        F.sum(one).alias("matched"), F.sum(F.when(F.col("factor") > 0, 1).otherwise(0)).alias("partial"), F.sum(F.when(F.col("factor") >= 0.30, 1).otherwise(0)).alias("near"),
        F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0)).alias("gained"), F.sum(F.col("w") * F.col("factor")).alias("half"), F.avg("shown").alias("shown"),
        F.sum(F.when(F.col("contradicted"), 1).otherwise(0)).alias("contradictions"), F.count("*").alias("concepts"),
        F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("concept")))).alias("missing"),
    )
    s = known.join(flat, KEY, "left").join(paired, KEY, "left").join(per, KEY, "left")
    zero = {c: 0 for c in ("hits", "n_items", "matched", "partial", "near", "contradictions", "concepts", "support_best")}
    s = s.fillna(zero | {c: 0.0 for c in ("closed_ratio", "closed_confidence", "pair_weight", "gained", "half", "shown")} | {"support_hit": False})

    rel, more = F.size(text.labels("answer_norm", lexicon.RELATIONS)), F.size(text.labels("answer_norm", lexicon.RELATIONS, lexicon.MORE_RELATIONS))
    s = s.withColumn("relations", more).withColumn("gate", gate(F.col("answer_norm"), F.size("tokens"), F.col("profile"), F.col("matched"), more))
    m, top = F.col("max_score"), F.col("max_score")
    some = (F.col("matched") > 0) | (F.col("partial") > 0)
    total = F.col("gained") + F.col("half") * F.col("gate.partial")
    total += F.when(some, m * relation_bonus(F.col("matched"), rel, F.size(text.words("answer_norm"))) * F.col("gate.relation")).otherwise(0.0)
    bonus = inference_bonus(F.col("matched"), F.col("near"), more, F.col("contradictions"), F.col("profile"), F.col("gate.inference"), F.col("gate.level"))
    total += m * bonus
    total += F.when(F.col("contradictions") == 0, m * support_bonus(F.col("support_hit"), F.col("support_best"), F.col("profile"))).otherwise(0.0)
    total *= F.when(F.col("contradictions") > 0, F.lit(1.0) - F.least(F.lit(0.38), F.lit(0.16) + F.lit(0.08) * (F.col("contradictions") - 1))).otherwise(1.0)
    covered = F.least(F.lit(1.0), (F.col("matched") + F.lit(0.55) * F.col("partial")) / F.greatest(F.col("concepts"), F.lit(1)))
    clear = F.col("contradictions") == 0
    trust = F.lit(0.48) * F.col("shown") + F.lit(0.32) * covered + F.lit(0.20) * F.when(clear, 1.0).otherwise(0.35)
    strict = F.col("matched") / F.greatest(F.col("concepts"), F.lit(1))
    short = F.col("profile").isin("brief", "short")
    trust = F.when(short & (F.col("matched") > 0) & clear, F.greatest(trust, F.when(strict < 0.80, 0.68).otherwise(0.82))).otherwise(trust)
    trust = F.when(F.col("partial") > 0, F.greatest(trust, F.when(F.col("gate.level").isin("very brief", "brief"), 0.42).when(F.col("profile") == "developed", 0.52).otherwise(0.46))).otherwise(trust)
    trust = F.when(bonus > 0, F.greatest(trust, F.lit(0.58))).otherwise(trust)
    trust = F.round(clamp(F.when(clear, trust).otherwise(F.least(trust, F.lit(0.58))), 0, 1), 2)

    kind = F.col("item_type")
    tf = true_false(F.col("answer_norm"), F.transform(F.coalesce("accepted_answers", F.expr("array()").cast("array<string>")), text.normalize))
    ratio = enumeration(F.col("hits"), F.coalesce("required", F.col("n_items")))
    as_closed = kind.isin(lexicon.CLOSED) | (F.col("n_criteria") == 0) & (kind == "criteria")
    score = (
        F.when(kind == "true_false", tf["ratio"] * m).when(kind.isin(lexicon.ENUMERATIONS), ratio * m).when(kind == "classification_matching", F.least(F.col("pair_weight"), m))
        .when(as_closed, F.col("closed_ratio") * m).otherwise(clamp(total, 0, top))
    )
    confidence = (
        F.when(kind == "true_false", tf["confidence"]).when(kind.isin(lexicon.ENUMERATIONS), ratio).when(kind == "classification_matching", F.col("pair_weight") / m)
        .when(as_closed, F.col("closed_confidence")).otherwise(trust)
    )
    blank = F.col("answer_norm") == ""
    s = s.withColumn("score", F.when(blank, 0.0).otherwise(score)).withColumn("confidence", F.when(blank, 0.1).otherwise(confidence))
    s = s.select(*KEY, "item_type", "max_score", "profile", "score", "confidence", "matched", "partial", "concepts", "contradictions", "relations", F.coalesce("missing", F.expr("array()").cast("array<string>")).alias("missing"))
    all_rows = answers.withColumn("answer_norm", text.normalize("answer")).join(s, KEY)
    return all_rows.withColumn("status", F.when(F.col("answer_norm") == "", "review").otherwise(status(F.col("confidence"))))
