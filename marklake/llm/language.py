"""Operator 3, language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes with the counts of what follows.  A byte
after a context costs -log2 of its share; where the context has not seen it, an escape (method C: as many
escapes as different successors) is paid and the next shorter context is asked, down to a uniform byte.
Statistics are frozen after fitting.  The text is coded word by word, each word beginning from a space and
ending with one: contexts do not reach over spaces, so a word always costs the same and the exact code
length of a text is the sum over its words.  The language with the shortest code is predicted; the score
is its share after ``TEMPER`` of the bits, 0 to 1.

Fitted on at most ``SAMPLE`` documents of each language, those with the smallest hashes of their ids, each text once
and none above ``EXAMPLE_BYTES``; prediction covers every whole text.  Case of A-Z, punctuation and spacing carry no weight.

Texts that are null or hold no letter give ``und``, as all do if nothing is learned; ties go to the
smaller name.  Repeated rows get equal results; null ids are passed through and count as learnable; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import EXAMPLE_BYTES, mod_of_id, pieces, ship, table
from .words import plain_words

ORDER = 4
SAMPLE = 300
SALTS = 64
TEMPER = 0.2
REMEMBER = 200_000
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Trees:
    """All languages' trees together: rows of code lengths in bits, a column for each language.  ``coded``
    has the row of a byte after a context (both joined), escapes included; ``escapes`` that of leaving a
    context for a byte no language has seen there."""

    names: list[str]
    coded: dict[bytes, int]
    escapes: dict[bytes, int]
    bits: np.ndarray

    def rows(self, word: bytes) -> list[int]:
        s, out, coded, escapes = b" " + word + b" ", [], self.coded, self.escapes
        for i in range(1, len(s)):
            for k in range(min(ORDER, i), -1, -1):
                if (r := coded.get(s[i - k : i + 1])) is not None:
                    out.append(r)
                    break
                if (r := escapes.get(s[i - k : i])) is not None:
                    out.append(r)
            else:
                out.append(0)
        return out

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word in each language."""
        rows = [self.rows(w) for w in words]
        if not rows:
            return np.zeros((0, len(self.names)), np.float32)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
        flat = np.fromiter((x for r in rows for x in r), np.int32)
        return np.add.reduceat(self.bits[flat], starts, axis=0)


def grow(words: dict[str, Counter]) -> Trees:
    """Trees from the word counts of each language."""
    names = sorted(words)
    counts: list[dict[bytes, dict[int, int]]] = []
    for name in names:
        tree: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for word, n in words[name].items():
            s = b" " + word + b" "
            for i in range(1, len(s)):
                for k in range(min(ORDER, i) + 1):
                    tree[s[i - k : i]][s[i]] += n
        counts.append(tree)
    totals = [{c: (sum(t.values()), len(t)) for c, t in tree.items()} for tree in counts]
    contexts = sorted(set().union(*counts), key=len)
    coded, escapes, bits = {}, {}, [[8.0] * len(names)]
    for c in contexts:
        for symbol in sorted(set().union(*(tree[c] for tree in counts if c in tree))):
            below = bits[coded.get(c[1:] + bytes([symbol]), 0)] if c else bits[0]
            row = []
            for i, tree in enumerate(counts):
                if c not in tree:
                    row.append(below[i])
                    continue
                total, kinds = totals[i][c]
                n = tree[c].get(symbol, 0)
                row.append(-np.log2(n / (total + kinds)) if n else -np.log2(kinds / (total + kinds)) + below[i])
            coded[c + bytes([symbol])] = len(bits)
            bits.append(row)
        escapes[c] = len(bits)
        bits.append([-np.log2(totals[i][c][1] / sum(totals[i][c])) if c in tree else 0.0 for i, tree in enumerate(counts)])
    return Trees(names, coded, escapes, np.array(bits, np.float32))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` documents of each language of ``docs`` (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    # The first of each of SALTS parts of a language, then of all: no task sees a whole language.
    part = F.pmod("h", F.lit(SALTS))
    some = known.withColumn("n", F.row_number().over(Window.partitionBy("lang", part).orderBy("h", "doc_id"))).filter(F.col("n") <= sample)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    # A bounded number of ids for each language comes to the driver, then their texts, of bounded length.
    chosen = {r.doc_id for r in some.withColumn("n", first).filter(F.col("n") <= sample).select("doc_id").collect()}
    texts = docs.filter(F.col("doc_id").isin(list(chosen)) & (F.octet_length("text") <= EXAMPLE_BYTES) & F.col("lang").isNotNull())
    got = texts.select("text", "lang").distinct().toArrow() if chosen else None
    words: dict[str, Counter] = defaultdict(Counter)
    for t, lang in zip(got.column("text"), got.column("lang").to_pylist()) if got else ():
        unique, ids, _ = plain_words(pa.array([t.as_py()], pa.string()))
        for i, n in enumerate(np.bincount(ids, minlength=len(unique)).tolist()):
            if n:
                words[str(lang)][unique[i]] += n
    return grow(words)


class Scorer:
    """Code lengths of batches of texts, remembering words up to a bound."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.place: dict[bytes, int] = {}
        self.known = np.zeros((REMEMBER, len(trees.names)), np.float32)

    def of(self, texts: pa.Array) -> np.ndarray:
        unique, ids, bounds = plain_words(texts)
        if len(self.place) + len(unique) > REMEMBER:
            self.place.clear()
        new = [w for w in unique if w not in self.place]
        if len(new) > REMEMBER:
            per_word = self.trees.lengths(unique)
        else:
            start = len(self.place)
            self.known[start : start + len(new)] = self.trees.lengths(new)
            self.place.update(zip(new, range(start, start + len(new))))
            per_word = self.known[np.fromiter(map(self.place.__getitem__, unique), np.int64, len(unique))]
        out = np.zeros((len(texts), len(self.trees.names)))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full] = np.add.reduceat(per_word[ids], bounds[:-1][full], axis=0, dtype=np.float64)
        return out


def _predict(shared):
    held: dict[str, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        scorer = held.setdefault("scorer", Scorer(trees))
        for part in pieces(batches, "text"):
            text = part.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score = ["und"] * len(text), np.zeros(len(text))
            if trees.names:
                bits = scorer.of(text)
                best = bits.argmin(axis=1)
                share = np.exp2((bits.min(axis=1, keepdims=True) - bits) * TEMPER)
                score = np.where(letters, 1 / share.sum(axis=1), 0.0)
                names = [trees.names[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """lang_pred and score for each row of ``docs`` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    ship(spark)
    # The trees are bounded by the sample they were grown from.
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(spark.sparkContext.broadcast(trees)), RESULT)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; held-out ones teach nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(mod_of_id("doc_id", 4) == 2, F.lit(False)))
    return predict(docs, fit(docs.filter(~F.col("held_out"))))
