"""Text-rule queries over documents, conversations and benchmark passages.

Answers are the users' turns of conversations; the question of a turn is ``turn % 8``, and a benchmark passage
is a target of question ``item_id % 8``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.functions import lexicon, text
from marklake.operators import diagnose, match, scoring
from marklake.operators.insight import rounded
from marklake.shipping import spread
from marklake.sources import rubric

READ = lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet")


def documents(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The columns of documents that a query needs; its work on the texts goes to all cores."""
    return spread(READ(s, d, "documents").select("doc_id", "text", *columns))


HEADS = 1 << 16
MARKS = ["the", "and", "von", "und", "les", "des", "licensed", "version", "copyright", "email", "http", "software"]


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce({x}, '')))), '[^a-z0-9\\s/._-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens_sql(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: length(t) > 2 AND t NOT IN {in_sql(lexicon.STOPWORDS)})"


def stem_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) > {len(s) + 4} THEN left({t}, length({t}) - {len(s)})" for s in lexicon.SUFFIXES) + f" ELSE {t} END"


def stems_sql(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: {stem_sql('t')})"


def profile_sql(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'empty' WHEN {n} <= 3 THEN 'brief' WHEN {n} <= 8 THEN 'short' ELSE 'developed' END"


def overlap_sql(a: str, t: str) -> str:
    both = f"len(list_intersect({a}, {t}))"
    return f"CASE WHEN len({a}) = 0 OR len({t}) = 0 THEN 0 ELSE CAST(round((0.7::DOUBLE * {both} / len({t}) + 0.3::DOUBLE * {both} / greatest(1, least(len({a}), len({t})))) * 100.0::DOUBLE) AS INTEGER) END"


ANSWERS = f"""a0 AS (
  SELECT conv_id, turn, turn % 8 AS question_id, {norm_sql("text")} AS answer_norm FROM conversations WHERE role = 'user'
), a AS (
  SELECT *, {tokens_sql("answer_norm")} AS tokens, list_distinct({stems_sql(tokens_sql("answer_norm"))}) AS stems FROM a0
), t0 AS (
  SELECT item_id, item_id % 8 AS question_id, {norm_sql("text")} AS variant_norm FROM benchmark
), t AS (
  SELECT *, list_distinct({stems_sql(tokens_sql("variant_norm"))}) AS variant_stems FROM t0
), p AS (
  SELECT conv_id, turn, a.question_id, answer_norm, tokens, stems, item_id, variant_norm, variant_stems FROM a JOIN t ON a.question_id = t.question_id
)"""


def answers(s: SparkSession, d: str) -> DataFrame:
    c = READ(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.col("turn") % 8).alias("question_id"), F.col("text").alias("answer"))
    return match.answers_view(c)


def passages(s: SparkSession, d: str) -> DataFrame:
    b = READ(s, d, "benchmark").select("item_id", (F.col("item_id") % 8).alias("question_id"), text.normalize("text").alias("variant_norm"))
    return b.withColumn("variant_stems", F.array_distinct(text.stems(text.tokens("variant_norm"))))


def normalize_text(s, d):
    return documents(s, d).select("doc_id", text.normalize("text").alias("n")).select("doc_id", F.length("n").alias("length"), F.md5("n").alias("digest"))


def semantic_tokens(s, d):
    t = documents(s, d).select("doc_id", text.tokens(text.normalize("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def stem_tokens(s, d):
    t = documents(s, d).select("doc_id", text.stems(text.tokens(text.normalize("text"))).alias("t"))
    return t.select("doc_id", F.md5(F.array_join("t", " ")).alias("digest"))


def length_profile(s, d):
    return answers(s, d).groupBy("profile").agg(F.count("*").alias("answers"))


def contains_match(s, d):
    """Documents that hold a passage: those that share the hash of its first words (six, or all of a shorter one) are
    candidates, and the whole normalized passage decides.  No scan of all pairs: windows that begin no passage are
    dropped by a filter of at most ``HEADS`` bits before any shuffle."""
    b = READ(s, d, "benchmark").select("item_id", text.normalize("text").alias("passage")).withColumn("w", text.words("passage")).filter("passage <> ''")
    heads = b.select("item_id", "passage", F.least(F.size("w"), F.lit(6)).alias("length"), F.xxhash64(F.slice("w", 1, F.least(F.size("w"), F.lit(6)))).alias("head"))
    lengths = [r.length for r in heads.select("length").distinct().collect()]  # 1 to 6
    # A row of bits: 64 to a long, at most HEADS bits whatever the number of passages.
    place = lambda h: F.pmod(h, F.lit(HEADS)).cast("int")
    bits = heads.select(place(F.col("head")).alias("b")).distinct().groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("bits"))
    words = {r.at: r.bits for r in bits.collect()}  # HEADS / 64 rows at most
    filled = F.lit([words.get(i, 0) for i in range(HEADS // 64)]) if words else F.array().cast("array<bigint>")
    docs = documents(s, d).select("doc_id", text.normalize("text").alias("n")).withColumn("w", text.words("n"))

    def windows(k: int) -> Column:
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, k)))

    found = F.array_distinct(F.flatten(F.array(*[windows(k) for k in lengths]))) if lengths else F.array().cast("array<bigint>")
    grams = docs.select("doc_id", "n", F.explode(found).alias("head"))
    grams = grams.withColumn("h", place(F.col("head"))).filter(F.getbit(F.element_at(filled, F.shiftright("h", 6) + 1), F.col("h").bitwiseAND(63)) == 1)
    hit = grams.join(heads, "head").filter(F.contains(F.concat(F.lit(" "), "n", F.lit(" ")), F.concat(F.lit(" "), "passage", F.lit(" "))))
    return hit.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


def closed_exact_match(s, d):
    """Whether an answer equals an accepted value: the normalized tokens of its question's first passage."""
    first = passages(s, d).groupBy("question_id").agg(F.min_by("variant_stems", "item_id").alias("accepted"))
    a = answers(s, d).join(first, "question_id")
    hit = F.exists("stems", lambda x: F.array_contains("accepted", x))
    return a.select("conv_id", "turn", hit.alias("correct"), F.when(hit, 1.0).otherwise(0.0).alias("score"))


def truefalse_score(s, d):
    """Orders' status letters as answers to a true-or-false question whose accepted answer is F."""
    o = READ(s, d, "orders").withColumn("r", scoring.true_false(text.normalize("o_orderstatus"), F.array(F.lit("f"))))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("answers"), F.sum("r.ratio").alias("score"), F.round(F.avg("r.confidence"), 2).alias("confidence"))


def negation_window(s, d):
    """Documents that negate one of their own meaningful words, whatever their language and length."""
    t = documents(s, d).select("doc_id", text.normalize("text").alias("n"))
    t = t.withColumn("stems", F.array_distinct(text.stems(text.tokens("n"))))
    return t.select("doc_id", text.negated("n", F.col("stems")).alias("negated"))


def relation_labels(s, d):
    n = documents(s, d).select("doc_id", text.normalize("text").alias("n"))
    found = text.labels("n", lexicon.RELATIONS, lexicon.MORE_RELATIONS)
    return n.select("doc_id", F.array_join(found, ",").alias("relations"), F.size(found).cast("long").alias("n_relations"))


def contradiction_flags(s, d):
    """Nations said, in each of the ways of the lexicon, to be of some region; the region that the table doesn't give
    them is the contradiction.  Denials and sentences of another region don't count."""
    n = READ(s, d, "nation").join(READ(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", text.normalize("n_name").alias("concept"), text.normalize("r_name").alias("own"))
    said = READ(s, d, "region").select("r_regionkey", text.normalize("r_name").alias("told"))
    ways = s.createDataFrame([(i, w) for i, w in enumerate(WAYS)], "way int, shape string")
    # Nations, regions and ways: as many rows as their three fixed lists give.
    x = n.join(said, F.col("n_nationkey") >= 0).join(ways, F.col("way") >= 0)
    x = x.withColumn("sentence", F.replace(F.replace("shape", F.lit("{c}"), F.col("concept")), F.lit("{v}"), F.col("told")))
    return x.select("n_nationkey", "r_regionkey", "way", (diagnose.wrong_relation(F.col("sentence"), F.col("concept"), F.col("told")) & (F.col("told") != F.col("own"))).alias("wrong"))


WAYS = [
    "{c} es {v}", "{c} son {v}", "{c} corresponde a {v}", "{c} corresponde al {v}", "{c} funciona como {v}", "{c} se define como {v}", "{c} consiste en {v}", "creo que es un {v} y {c}", "eso es una {v} o {c}", "siempre son {v} y {c}",
    "{c} y lo demas es en partes {v}", "{c} no es {v}", "{c} no son {v}", "{c} no corresponde a {v}", "{c} no funciona como {v}", "{c} y otra cosa", "otra cosa es {v}", "la {c} es una de las muchas cosas que hay por alla en toda la gran {v}", "{c} junto a {v}",
]
WRONG = [True] * 11 + [False] * 8


def _graded(s, d):
    """Documents as answers; the concepts that they hold are words of a fixed list, the relations those of the lexicon."""
    n = documents(s, d).select("doc_id", text.normalize("text").alias("n")).withColumn("tokens", text.tokens("n"))
    rel = F.size(text.labels("n", lexicon.RELATIONS))
    return n.select("doc_id", "n", F.size("tokens").alias("k"), F.size(F.array_intersect("tokens", F.array(*[F.lit(x) for x in MARKS]))).alias("concepts"), rel.alias("relations"), text.length_profile("tokens").alias("profile"))


def quality_gate(s, d):
    g = _graded(s, d)
    out = g.select("doc_id", scoring.gate(F.col("n"), F.col("k"), F.col("profile"), F.col("concepts"), F.col("relations")).alias("g"))
    return out.select("doc_id", "g.partial", "g.inference", "g.relation", "g.level")


def partial_factor(s, d):
    e = READ(s, d, "events").select("event_id", (F.col("event_id") % 101).cast("int").alias("score"), F.col("event_type"))
    profile = F.element_at(F.array(*[F.lit(p) for p in ("brief", "short", "developed")]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", scoring.partial_factor(F.col("score"), profile, F.col("event_id") % 17 == 0).alias("factor"))


def cognitive_level(s, d):
    li = READ(s, d, "lineitem")
    share, coverage = F.col("l_quantity") / 50.0, F.lit(1.0) - F.col("l_tax") * 10
    profile = F.when(F.col("l_linenumber") > 3, "developed").otherwise("short")
    e = scoring.cognitive_level(share, coverage, (F.col("l_linenumber") % 3).cast("int"), profile, F.lit(1.0) - F.col("l_discount") * 3)
    return li.select(e.alias("level")).groupBy("level").agg(F.count("*").alias("answers"))


def error_types(s, d):
    g = _graded(s, d)
    contradicted = (text.negated("n", F.array(*[F.lit(text.stem_py(m)) for m in MARKS]))).cast("int")
    e = diagnose.error_type(F.col("n"), F.col("k"), F.col("profile"), F.lit(3), F.least("concepts", F.lit(3)), F.col("relations"), contradicted)
    return g.select("doc_id", e["error"].alias("error"), e["severity"].alias("severity"))


def enumeration_score(s, d):
    """Distinct parts of an order against five required ones, for three points."""
    li = READ(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("hits"))
    return li.select("l_orderkey", "hits", rounded(scoring.enumeration(F.col("hits"), F.lit(5)) * 3.0, 3).alias("score"))


def matching_score(s, d):
    """Pairs that hold on both sides: lines shipped whole and at a discount, 1 point each, 4 at most."""
    both = (F.col("l_quantity") >= 10) & (F.col("l_discount") >= 0.03)
    li = READ(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(both, 1.0).otherwise(0.0)).alias("w"))
    return li.select("l_orderkey", F.least("w", F.lit(4.0)).alias("score"), F.round(F.col("w") / 4.0, 3).alias("confidence"))


def weight_inference(s, d):
    """Nations as concepts of their region's question, whose prompt names every other one."""
    n = READ(s, d, "nation").join(READ(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = n.select(F.col("n_regionkey").alias("question_id"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("target_pos"), F.col("n_name").alias("concept"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("prompt"))
    return scoring.criterion_weights(c).select("question_id", "concept", rounded("share", 6).alias("share"))


def cosine_pairs(s, d):
    """Similarity of each vector with the one before it, by a join on the id."""
    e = READ(s, d, "embeddings").select("vec_id", "embedding", "label")
    prev = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    c = match.cosine("embedding", "before")
    return e.join(prev, "vec_id").select("vec_id", rounded(c, 4).alias("cosine"), match.embedding_score(rounded(c, 6)).alias("score"))


def cosine_topk(s, d):
    """The three vectors of each label nearest to the label's first one."""
    e = READ(s, d, "embeddings").select("vec_id", "embedding", "label")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    c = e.join(first, "label").select("label", "vec_id", rounded(match.cosine("embedding", "head"), 4).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("cosine").desc(), "vec_id"))
    return c.withColumn("rank", rank).filter("rank <= 3")


def dedupe_texts(s, d):
    n = documents(s, d).select("doc_id", F.md5(text.normalize("text")).alias("digest"))
    return n.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def md5_cache_key(s, d):
    key = F.md5(F.concat_ws("||", "lang", "source", text.normalize("text")))
    return documents(s, d, "lang", "source").select("doc_id", key.alias("cache_key"), F.substring(key, 1, 12).alias("session_id"))


def slug(s, d):
    return READ(s, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type"), "part").alias("slug"))


def split_values(s, d):
    """Cells packed with bullets, numbers, semicolons, commas and pairs."""
    cell = F.concat(F.lit("1) "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ", ").otherwise("; - "), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, " y ").otherwise(" | "), F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, ": x, z").otherwise(" "))
    v = READ(s, d, "part").select("p_partkey", text.split_values(cell).alias("v"))
    return v.select("p_partkey", F.size("v").cast("long").alias("n_values"), F.array_join("v", "#").alias("joined"))


SPLIT_CELL = "'1) ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ', ' ELSE '; - ' END || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' y ' ELSE ' | ' END || p_type || CASE WHEN p_partkey % 5 = 0 THEN ': x, z' ELSE ' ' END"


def header_normalize(s, d):
    return READ(s, d, "pages").select("page_id", text.header("url").alias("header"), text.first_number("url").alias("number"))


def item_type_map(s, d):
    """Types by the words of the lexicon, dealt to events."""
    names = ["Verdadero/Falso", "V F", "Completar", "Respuesta exacta", "Enumeración", "LISTA", "Relacionar", "pares", "Pregunta abierta", "Ensayo", "", "causal explanation"]
    e = READ(s, d, "events").withColumn("t", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int")))
    return e.groupBy(rubric.item_type("t").alias("item_type")).agg(F.count("*").alias("questions"))


_PREV = "CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DOUBLE)"
_SLUG = "regexp_replace(regexp_replace(strip_accents(p_name || ' / ' || p_type), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_TYPES = ["true_false", "true_false", "completion", "short_exact_answer", "enumeration_conceptual", "enumeration_conceptual", "classification_matching", "classification_matching", "criteria", "criteria", "criteria", "causal_explanation"]


def _labels_sql(n: str, *maps) -> str:
    found: dict[str, list[str]] = {}
    for m in maps:
        for label, phrases in m.items():
            found.setdefault(label, []).extend(phrases)
    cases = [f"CASE WHEN {' OR '.join(f"contains({n}, '{p}')" for p in dict.fromkeys(phrases))} THEN '{label}' END" for label, phrases in sorted(found.items())]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_WORDS = "list_filter(string_split(n, ' '), lambda x: x <> '')"
_GRADED = f"""n AS (SELECT doc_id, {norm_sql("text")} AS n FROM documents), k AS (
  SELECT doc_id, n, len({tokens_sql("n")}) AS k, len(list_distinct(list_intersect({tokens_sql("n")}, {MARKS}))) AS concepts, len({_labels_sql("n", lexicon.RELATIONS)}) AS relations FROM n
), g AS (SELECT *, {profile_sql("k")} AS profile FROM k)"""


def _band(a, b, c, e):
    return f"CASE WHEN k <= 3 THEN {a}::DOUBLE WHEN k <= 6 THEN {b}::DOUBLE WHEN k <= 10 THEN {c}::DOUBLE ELSE {e}::DOUBLE END"


def _gate_value(bands, adds, least) -> str:
    v = f"({_band(*bands)} + CASE WHEN concepts >= 1 THEN {adds[0]}::DOUBLE ELSE 0 END + CASE WHEN concepts >= 2 THEN {adds[1]}::DOUBLE ELSE 0 END + CASE WHEN relations >= 1 THEN {adds[2]}::DOUBLE ELSE 0 END)"
    full = f"CASE WHEN profile = 'developed' AND (concepts >= 1 OR relations >= 1) THEN greatest({v}, {least}::DOUBLE) ELSE {v} END"
    return f"CASE WHEN vague THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {full})), 3) END"


_NEG = in_sql(lexicon.NEGATORS)
QUERIES = {f.__name__: f for f in (
    normalize_text, semantic_tokens, stem_tokens, length_profile, contains_match, closed_exact_match, truefalse_score, negation_window, relation_labels,
    contradiction_flags, quality_gate, partial_factor, cognitive_level, error_types, enumeration_score, matching_score, weight_inference, cosine_pairs, cosine_topk, dedupe_texts, md5_cache_key, slug, split_values, header_normalize, item_type_map,
)}
ORACLE_SQL = {
    "normalize_text": f"WITH n AS (SELECT doc_id, {norm_sql('text')} AS n FROM documents) SELECT doc_id, CAST(length(n) AS INTEGER) AS length, md5(n) AS digest FROM n",
    "semantic_tokens": f"WITH n AS (SELECT doc_id, {tokens_sql(norm_sql('text'))} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM n",
    "stem_tokens": f"WITH n AS (SELECT doc_id, {stems_sql(tokens_sql(norm_sql('text')))} AS t FROM documents) SELECT doc_id, md5(array_to_string(t, ' ')) AS digest FROM n",
    "length_profile": f"WITH {ANSWERS} SELECT {profile_sql('len(tokens)')} AS profile, count(*) AS answers FROM a GROUP BY 1",
    "contains_match": f"""WITH n AS (SELECT doc_id, {norm_sql("text")} AS n FROM documents), h AS (SELECT item_id, {norm_sql("text")} AS passage FROM benchmark)
SELECT item_id, count(*) AS documents FROM n JOIN h ON passage <> '' AND contains(' ' || n || ' ', ' ' || passage || ' ') GROUP BY item_id""",
    "closed_exact_match": f"""WITH {ANSWERS}, f AS (SELECT question_id, arg_min(variant_stems, item_id) AS accepted FROM t GROUP BY question_id)
SELECT conv_id, turn, list_has_any(stems, accepted) AS correct, CASE WHEN list_has_any(stems, accepted) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM a JOIN f ON a.question_id = f.question_id""",
    "truefalse_score": "SELECT o_orderstatus, count(*) AS answers, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS score, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END), 2) AS confidence FROM orders GROUP BY o_orderstatus",
    "negation_window": f"""WITH n AS (SELECT doc_id, {norm_sql("text")} AS n FROM documents), w AS (
  SELECT doc_id, {_WORDS} AS w, list_distinct({stems_sql(tokens_sql("n"))}) AS s FROM n
), m AS (SELECT doc_id, list_transform(w, lambda t: list_contains(s, {stem_sql("t")})) AS hit, list_transform(w, lambda t: t IN {_NEG} OR ({stem_sql("t")}) IN {_NEG}) AS neg, w, s FROM w)
SELECT doc_id, len(list_filter(range(1, len(w) + 1), lambda i: hit[i] AND list_contains(list_slice(neg, greatest(1, i - 4), i), true))) > 0 AS negated FROM m""",
    "relation_labels": f"WITH n AS (SELECT doc_id, {norm_sql('text')} AS n FROM documents), l AS (SELECT doc_id, {_labels_sql('n', lexicon.RELATIONS, lexicon.MORE_RELATIONS)} AS l FROM n) SELECT doc_id, array_to_string(l, ',') AS relations, len(l) AS n_relations FROM l",
    "contradiction_flags": f"SELECT n_nationkey, r_regionkey, CAST(way AS INTEGER) AS way, w AND n_regionkey <> r_regionkey AS wrong FROM nation, region, (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(WRONG))}) t(way, w)",
    "quality_gate": f"""WITH {_GRADED}, v AS (SELECT *, n = '' OR n IN {in_sql(lexicon.VAGUE)} AS vague FROM g) SELECT doc_id,
  {_gate_value((0.20, 0.40, 0.65, 0.92), (0.08, 0.08, 0.05), 0.95)} AS partial, {_gate_value((0.00, 0.15, 0.45, 0.85), (0.08, 0.12, 0.12), 0.90)} AS inference,
  {_gate_value((0.25, 0.45, 0.70, 0.90), (0.05, 0.08, 0.10), 0.90)} AS relation,
  CASE WHEN vague THEN 'no evidence' WHEN k <= 3 THEN 'very brief' WHEN k <= 6 THEN 'brief' WHEN k <= 10 THEN 'sufficient' ELSE 'developed' END AS level FROM v""",
    "partial_factor": """WITH e AS (SELECT event_id, event_id % 101 AS s, ['brief', 'short', 'developed'][event_id % 3 + 1] AS p FROM events)
SELECT event_id, CAST(CASE WHEN event_id % 17 = 0 THEN 0.0 WHEN s >= 66 THEN CASE WHEN p = 'developed' THEN 0.75 ELSE 0.62 END WHEN s >= 60 THEN CASE WHEN p <> 'brief' THEN 0.62 ELSE 0.45 END
  WHEN s >= 54 THEN CASE WHEN p = 'developed' THEN 0.48 ELSE 0.32 END WHEN s >= 48 THEN CASE WHEN p = 'developed' THEN 0.32 ELSE 0.0 END ELSE 0.0 END AS DOUBLE) AS factor FROM e""",
    "cognitive_level": """WITH e AS (SELECT l_quantity / 50.0::DOUBLE AS s, 1.0::DOUBLE - l_tax * 10 AS c, l_linenumber % 3 AS r, l_linenumber > 3 AS dev, 1.0::DOUBLE - l_discount * 3 AS conf FROM lineitem)
SELECT CASE WHEN s <= 0.05 THEN 'E0' WHEN s < 0.40 OR c < 0.30 THEN 'E1' WHEN s < 0.70 THEN 'E2' WHEN s < 0.90 OR r = 0 THEN 'E3' WHEN dev AND conf >= 0.75 THEN 'E4' ELSE 'E3' END AS level, count(*) AS answers FROM e GROUP BY 1""",
    "error_types": f"""WITH {_GRADED}, c AS (SELECT *, least(concepts, 3) AS present, {_WORDS} AS w FROM g), m AS (
  SELECT *, list_transform(w, lambda t: list_contains({[text.stem_py(m) for m in MARKS]}, {stem_sql("t")})) AS hit, list_transform(w, lambda t: t IN {_NEG} OR ({stem_sql("t")}) IN {_NEG}) AS neg FROM c
), v AS (SELECT *, len(list_filter(range(1, len(w) + 1), lambda i: hit[i] AND list_contains(list_slice(neg, greatest(1, i - 4), i), true))) > 0 AS negated FROM m), e AS (
  SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN n IN {in_sql(lexicon.VAGUE)} OR k <= 1 THEN 'vague' WHEN negated THEN 'contradiction' WHEN present = 0 THEN 'off focus'
    WHEN present < 3 AND profile IN ('brief', 'short') THEN 'brief and partial' WHEN present < 3 THEN 'incomplete' WHEN relations = 0 AND profile = 'developed' THEN 'weak relation' ELSE 'none' END AS error FROM v
) SELECT doc_id, error, CASE WHEN error IN ('empty', 'contradiction', 'off focus') THEN 'high' WHEN error IN ('vague', 'incomplete', 'weak relation') THEN 'medium' ELSE 'low' END AS severity FROM e""",
    "enumeration_score": "SELECT l_orderkey, count(DISTINCT l_partkey) AS hits, round(CAST(least(count(DISTINCT l_partkey), 5) AS DOUBLE) / 5 * 3.0::DOUBLE + 1e-9::DOUBLE, 3) AS score FROM lineitem GROUP BY l_orderkey",
    "matching_score": "WITH w AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity >= 10 AND l_discount >= 0.03 THEN 1 ELSE 0 END) AS DOUBLE) AS w FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, least(w, 4.0::DOUBLE) AS score, round(w / 4.0::DOUBLE, 3) AS confidence FROM w",
    "weight_inference": f"""WITH c AS (SELECT n_regionkey AS question_id, n_name AS concept, CAST(floor(n_nationkey / 5) AS INTEGER) AS pos, {norm_sql("n_name")} AS c, n_nationkey % 2 = 0 AS named FROM nation), r AS (
  SELECT *, 1.0::DOUBLE + CASE WHEN pos = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN named THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN {" OR ".join(f"contains(c, '{x}')" for x in lexicon.CENTRAL)} THEN 0.25::DOUBLE ELSE 0 END
    + CASE WHEN len(string_split(c, ' ')) >= 2 THEN 0.08::DOUBLE ELSE 0 END AS raw FROM c
) SELECT question_id, concept, round(raw / sum(raw) OVER (PARTITION BY question_id) + 1e-9::DOUBLE, 6) AS share FROM r""",
    "cosine_pairs": f"SELECT e.vec_id, round({_PREV} + 1e-9::DOUBLE, 4) AS cosine, CAST(round(100.0::DOUBLE * (round({_PREV} + 1e-9::DOUBLE, 6) + 1.0::DOUBLE) / 2.0::DOUBLE) AS INTEGER) AS score FROM embeddings e JOIN embeddings b ON b.vec_id + 1 = e.vec_id",
    "cosine_topk": f"""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label), c AS (
  SELECT e.label, e.vec_id, round({_PREV} + 1e-9::DOUBLE, 4) AS cosine FROM embeddings e JOIN f b ON e.label = b.label
) SELECT label, vec_id, cosine, CAST(row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""",
    "dedupe_texts": f"SELECT md5({norm_sql('text')}) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "md5_cache_key": f"WITH k AS (SELECT doc_id, md5(concat_ws('||', lang, source, {norm_sql('text')})) AS cache_key FROM documents) SELECT doc_id, cache_key, left(cache_key, 12) AS session_id FROM k",
    "slug": f"SELECT p_partkey, coalesce(nullif(left(lower({_SLUG}), 80), ''), 'part') AS slug FROM part",
    "split_values": f"""WITH c AS (SELECT p_partkey, regexp_replace(trim({SPLIT_CELL}), '(?i)\\s+y\\s+', ';', 'g') AS c FROM part), v AS (
  SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(c, CASE WHEN contains(c, ':') THEN '\\s*[;\\n/|]\\s*' ELSE '\\s*[;\\n/|,]\\s*' END), lambda p: trim(regexp_replace(p, '^\\s*[-–—\\d).]+\\s*', ''))), lambda p: p <> '') AS v FROM c
) SELECT p_partkey, len(v) AS n_values, array_to_string(v, '#') AS joined FROM v""",
    "header_normalize": f"SELECT page_id, translate(replace({norm_sql('url')}, ' ', ''), '-.', '__') AS header, regexp_extract(url, '(\\d+)', 1) AS number FROM pages",
    "item_type_map": f"SELECT [{', '.join(f"'{t}'" for t in _TYPES)}][event_id % {len(_TYPES)} + 1] AS item_type, count(*) AS questions FROM events GROUP BY 1",
}
