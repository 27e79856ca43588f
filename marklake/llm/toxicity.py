"""Operator 6, toxicity by the nearest labelled examples.

Examples and documents are TF-IDF vectors over all terms of the examples: (1 + ln tf) * ln(1 + N / df), times
``FLOOR`` plus, for terms whose document counts differ by label beyond chance (a chi-square of ``CHI`` or more), the
size of that difference (phi, 0 to 1).  So every term weighs, and what tells the labels apart weighs most.

The ``K`` examples of highest cosine are found exactly through a block-max inverted index.  Examples stand in blocks
of ``BLOCK``, alike ones together; for each term and block the index has the largest weight.  The few terms that one
example in ``COMMON`` or more holds have their postings in a matrix, so that their part of all cosines is one product.
A document's bound for a block is the largest such part in it and, for the other terms, the sum of their weights
times the block's largest ones.  The ``FIRST`` blocks of highest bounds are scored, which gives a k-th cosine; then
all other blocks whose bound reaches it.  Many documents walk side by side.

Votes weigh by cosine, and labels equally however many examples each has.  A part of the sample (``CALIBRATION``)
is kept out of the index: on it a rising curve is fitted that turns the share of toxic votes into the probability
of the label among all labelled rows.  The neighbours are the evidence.

Learned on at most ``SAMPLE`` labelled documents of each label, those with the smallest hashes of their ids, without
texts above ``EXAMPLE_BYTES`` (which bounds what comes to the driver); idf is counted on them too.  Every whole text
is scored.  Ties of cosine go to the smaller example id.

Null and empty texts, and those without a term of the examples, have no neighbours: they get the score of a
document with as many votes for each label as chance gives.  Without labels of both kinds every score is the
labels' mean, or 0.  Repeated rows get equal results; null ids are passed through and count as learnable; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EXAMPLE_BYTES, claim, lists, mod_of_id, pieces, ship, table
from .words import plain_words

SAMPLE = 2000
CALIBRATION = 4  # every so many-th example calibrates
FLOOR, CHI = 0.01, 24.0
K, BLOCK, FIRST, COMMON = 50, 64, 4, 8
SIDE_BY_SIDE, CELLS, POSTINGS = 128, 1 << 20, 1 << 20  # documents, terms times blocks and postings that are looked at together
DIGITS = 10**12  # cosines are compared by so many parts of one
THRESHOLD = 0.7
TILT = 0.02  # of the score is the share of votes itself, so that flat stretches of the curve keep its order
RESULT = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>"


def term_counts(texts: pa.Array, terms: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, term, count) of each term of each text, in that order, and the terms' names."""
    unique, ids, bounds = plain_words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if terms is not None:
        number = np.fromiter((terms.get(w, -1) for w in unique), np.int64, len(unique))[ids]
        doc, ids = doc[number >= 0], number[number >= 0]
    width = max(1, len(unique) if terms is None else len(terms))
    pairs, counts = np.unique(doc.astype(np.int64) * width + ids, return_counts=True)
    return pairs // width, pairs % width, counts, unique


def ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its stop in a row, and which range each is from."""
    n = stops - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(n) - n), n), of


def label_weights(df: np.ndarray, toxic_df: np.ndarray, n: int, n_toxic: float) -> np.ndarray:
    """What a term weighs by its counts: idf, times FLOOR and, beyond chance, phi."""
    a, b = toxic_df, df - toxic_df
    c, d = n_toxic - a, n - n_toxic - b
    phi2 = (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * (a + c) * (b + d))
    return np.log(1 + n / np.maximum(df, 1)) * (FLOOR + np.where(n * phi2 >= CHI, np.sqrt(phi2), 0.0))


@dataclass
class Index:
    """Postings of the examples' unit vectors by term and block, with the largest weight of each."""

    terms: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each term
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each example, as they stand in the blocks
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each example
    of_term: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first cell of each term
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each cell
    largest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weight of each cell
    of_cell: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first posting of each cell
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # example of each posting
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each term in ``common``, or -1
    common: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # [term, example]
    curve: tuple[np.ndarray, np.ndarray] | None = None
    mean: float = 0.0  # score without anything learned

    def vectors(self, doc: np.ndarray, term: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Weights of the terms of ``n`` unit vectors."""
        w = (1 + np.log(counts)) * self.weights[term]
        norm = np.sqrt(np.bincount(doc, w * w, n))
        return w / np.where(norm > 0, norm, 1.0)[doc]

    def nearest(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest of ``n`` documents, nearest first; -1 where there are fewer."""
        examples, blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        k = min(k, examples)
        if not k or not len(doc):
            return np.full((n, k), -1), np.zeros((n, k))
        often = self.column[term]
        q = np.zeros((n, len(self.common)))
        q[doc[often >= 0], often[often >= 0]] = w[often >= 0]
        cos = (q @ self.common).ravel()
        cell, of = ranges(self.of_term[term], self.of_term[term + 1])
        spot = doc[of] * blocks + self.block[cell]
        bound = np.maximum.reduceat(cos.reshape(n, examples), np.arange(0, examples, BLOCK), axis=1)
        bound += np.bincount(spot, w[of] * self.largest[cell], n * blocks).reshape(n, blocks)
        bound = bound * (1 + 1e-9) + 2 / DIGITS  # rounding must not prune
        # Ties go to the smaller id: keys are parts of one, then the ids' order downwards.
        order = np.empty(examples, np.int64)
        order[np.argsort(self.ids, kind="stable")] = np.arange(examples)[::-1]

        def look(wanted: np.ndarray) -> None:
            mine = np.flatnonzero(wanted.ravel()[spot])
            sizes = np.cumsum(self.of_cell[cell[mine] + 1] - self.of_cell[cell[mine]])
            start = 0
            while start < len(mine):
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + POSTINGS, side="right")))
                part = mine[start:stop]
                p, c = ranges(self.of_cell[cell[part]], self.of_cell[cell[part] + 1])
                np.add.at(cos, (doc[of[part]] * examples)[c] + self.at[p], w[of[part]][c] * self.weight[p])
                start = stop

        def keys() -> np.ndarray:
            return np.round(cos.reshape(n, examples) * DIGITS).astype(np.int64) * examples + order

        first = np.zeros((n, blocks), bool)
        head = min(max(FIRST, -(-k // BLOCK)), blocks)
        np.put_along_axis(first, np.argpartition(-bound, head - 1, axis=1)[:, :head], True, 1)
        look(first)
        kth = np.partition(keys(), examples - k, axis=1)[:, examples - k] // examples / DIGITS
        look((bound >= kth[:, None]) & ~first)
        found = keys()
        best = np.argpartition(found, examples - k, axis=1)[:, examples - k :]
        value = np.take_along_axis(found, best, 1)
        turn = np.argsort(-value, axis=1)
        best, value = np.take_along_axis(best, turn, 1), np.take_along_axis(value, turn, 1) // examples
        return np.where(value > 0, best, -1), np.where(value > 0, value / DIGITS, 0.0)

    def share(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Toxic part of the votes, with one vote for each label at the mean weight added."""
        if not len(self.ids):
            return np.full(len(found), 0.5)
        votes = np.where(found >= 0, cosines * self.votes[found], 0.0)
        toxic = (votes * self.toxic[found]).sum(axis=1)
        return (toxic + 0.005) / (votes.sum(axis=1) + 0.01)

    def score(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(found), self.mean)
        share = self.share(found, cosines)
        return (1 - TILT) * np.interp(share, *self.curve) + TILT * share

    def groups(self, doc: np.ndarray, term: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Documents that are scored together: few, and of few cells, or one."""
        cells = np.cumsum(np.bincount(doc, self.of_term[term + 1] - self.of_term[term], n)) if n else np.zeros(0)
        a = 0
        while a < n:
            b = int(np.searchsorted(cells, (cells[a - 1] if a else 0) + CELLS, side="right"))
            b = min(max(a + 1, b), a + SIDE_BY_SIDE, n)
            yield a, b
            a = b

    def neighbours(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the texts, group by group."""
        doc, term, counts, _ = term_counts(texts, self.terms)
        w = self.vectors(doc, term, counts, len(texts))
        for a, b in self.groups(doc, term, len(texts)):
            i, j = np.searchsorted(doc, (a, b))
            yield self.nearest(doc[i:j] - a, term[i:j], w[i:j], b - a)

    def shares(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0)] + [self.share(*x) for x in self.neighbours(texts)])

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Score, neighbours' ids and cosines of each text."""
        score, near, cosines = [np.zeros(0)], [], []
        for found, cos in self.neighbours(texts):
            score.append(self.score(found, cos))
            count = (found >= 0).sum(axis=1).tolist()
            near += [self.ids[f[:n]] for f, n in zip(found, count)]
            cosines += [c[:n] for c, n in zip(cos, count)]
        return np.concatenate(score), near, cosines


def build(ids: np.ndarray, texts: pa.Array, toxic: np.ndarray) -> Index:
    """The index of examples of both labels, not yet calibrated."""
    n, n_toxic = len(ids), float(toxic.sum())
    doc, term, counts, names = term_counts(texts)
    df = np.bincount(term, minlength=len(names)).astype(float)
    index = Index({w: t for t, w in enumerate(names)}, label_weights(df, np.bincount(term, toxic[doc], len(names)), n, n_toxic))
    w = index.vectors(doc, term, counts, n)
    # Alike examples stand together: by their label, then by the commonest term that they hold.
    common = np.full(n, -1)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(names))
    np.maximum.at(common, doc, len(names) - rank[term])
    place = np.empty(n, np.int64)
    stand = np.lexsort((ids, -common, toxic))
    place[stand] = np.arange(n)
    index.ids, index.toxic = ids[stand], toxic[stand].astype(float)
    index.votes = np.where(index.toxic > 0, 1 / n_toxic, 1 / (n - n_toxic)) * n / 2
    at = place[doc]
    often = np.flatnonzero(df * COMMON >= n)
    index.column = np.full(len(names), -1, np.int32)
    index.column[often] = np.arange(len(often))
    index.common = np.zeros((len(often), n))
    dense = index.column[term] >= 0
    index.common[index.column[term[dense]], at[dense]] = w[dense]
    at, term, w = at[~dense], term[~dense], w[~dense]
    order = np.lexsort((at, term))
    at, term, w = at[order], term[order], w[order]
    blocks = -(-n // BLOCK)
    cells, first = np.unique(term * blocks + at // BLOCK, return_index=True)
    index.of_cell = np.append(first, len(at)).astype(np.int64)
    index.block = (cells % blocks).astype(np.int32)
    index.of_term = np.searchsorted(cells // blocks, np.arange(len(names) + 1)).astype(np.int64)
    index.largest = np.maximum.reduceat(w, first) if len(first) else np.zeros(0)
    index.at, index.weight = at.astype(np.int32), w
    return index


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the curve through the weighted means of ``y`` that doesn't fall as x rises (adjacent violators are
    pooled), each mean with half a row of ``mean`` added."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for w, wy, wx in zip(weight[order], (weight * y)[order], (weight * x)[order]):
        pools.append([w, wy, wx])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    w, wy, wx = np.array(pools).T
    return wx / w, np.maximum.accumulate((wy + 0.5 * mean) / (w + 0.5))


def learn(ids: np.ndarray, texts: list[str], toxic: np.ndarray, rows: dict[int, int]) -> Index:
    """Index and calibration from examples in the order of their ids; ``rows``: how many labelled rows there are."""
    total = sum(rows.values())
    mean = rows.get(1, 0) / total if total else 0.0
    if not len(ids) or toxic.all() or not toxic.any():
        return Index(mean=mean)
    turn = np.empty(len(ids), np.int64)  # dealt out within each label
    for t in (0, 1):
        turn[toxic == t] = np.arange(int((toxic == t).sum()))
    held = turn % CALIBRATION == CALIBRATION - 1
    if not (toxic[held] == 1).any() or not (toxic[held] == 0).any():
        held = np.zeros(len(ids), bool)
    fitted, asked = np.flatnonzero(~held), np.flatnonzero(held)
    index = build(ids[fitted], pa.array([texts[i] for i in fitted], pa.string()), toxic[fitted])
    index.mean = mean
    if not len(asked):  # too few to spare any: shares count as they are
        index.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return index
    n = {t: int((toxic[asked] == t).sum()) for t in (0, 1)}
    share = index.shares(pa.array([texts[i] for i in asked], pa.string()))
    weight = np.array([rows.get(int(t), 1) / n[int(t)] for t in toxic[asked]])
    index.curve = monotone(share, toxic[asked].astype(float), weight / weight.mean(), mean)
    return index


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, example_bytes: int = EXAMPLE_BYTES) -> Index:
    """Learn from at most ``sample`` examples of each label of ``labels`` (doc_id, toxic)."""
    chosen, rows = None, {}
    labels = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    for r in labels.groupBy("toxic").count().collect():
        part = labels.filter(F.col("toxic") == r.toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen, rows[r.toxic] = part if chosen is None else chosen.unionByName(part), r["count"]
    if chosen is None:
        return Index()
    # At most 2 * sample rows are broadcast, and as many texts of at most example_bytes collected.
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= example_bytes)
    got = short.join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    text = got.column("text").to_pylist()
    first = np.array(sorted({t: i for i, t in reversed(list(enumerate(text)))}.values()), np.int64)  # each text once
    ids, toxic = got.column("doc_id").to_numpy()[first], got.column("toxic").to_numpy()[first]
    return learn(ids, [text[i] for i in first.tolist()], toxic, rows)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        index: Index = shared.value
        for part in pieces(batches, "text"):
            score, near, cosines = index.scores(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), lists(near, pa.int64()), lists(cosines, pa.float64())],
                ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"],
            )

    return run


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Score, prediction and evidence for each row of ``docs`` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    ship(spark)
    # The index is bounded by the sample it was built from.
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(spark.sparkContext.broadcast(index)), RESULT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every document; held-out labels teach nothing."""
    held = F.coalesce(mod_of_id("doc_id", 3) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held)
    return score(docs, fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").filter(~held)))
