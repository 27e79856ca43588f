"""Operator 2, mixing sources to target weights by balanced sampling (the cube method).

Targets: sources in order of code points, null last, weigh 5, 2, 1, repeating, and share all words by
weight; a target above 3 times its source's size stops there and the excess is shared again by weight.

Each document is taken ``floor(r)`` times, r being its source's target over its size, and once more with
probability ``r - floor(r)``.  Which ones is decided so that the number of documents and of words come
out as expected: a flight keeps three undecided documents, moves their probabilities along the null space
of the two totals, (s3 - s2, s1 - s3, s2 - s1) for sizes s, until one is decided, and lets in the next.
At most two of a flight stay undecided, long ones mostly, which short ones balance.  Flights run over blocks of about
``BLOCK`` documents of one source; the undecided of many blocks meet in the flight of the next level, until each
source has one block.  That one keeps ``RESERVE`` documents of all sizes out of its flight.  They and the two left are
the landing problem: of all ways to decide them that take the expected number of documents, rounded down or up, the
one whose words are nearest to the expected ones is found by halves (with a document more or less only where words
would be off by over a hundredth).  What a flight has decided stays.

So a source with a third of all rows is many blocks, and no step holds more than one.  The random numbers
depend on the block alone, and rows stand in the order of descending size, then doc_id, so reruns agree.

Null text has size 0 and counts with its source.  Sources may be null.  Empty table: no rows.  Repeated
rows are documents of their own.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, cut, fresh, pieces, raw, ship, table

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK, MERGE = 8192, 2048
EPS = 1e-9
NEAR = 0.01
RESERVE = 18  # documents of a source that are decided in landing, besides two of a flight


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("mixing")
    for part in pieces(batches, "text"):
        size = np.array([len(t.split()) if t else 0 for t in raw(part.column("text"))], np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("h"), pa.array(size)], ["doc_id", "source", "h", "size"])


def flight(p: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after a flight over documents of sizes ``s``: 0 or 1 but for two at most.  Sums of p
    and of p * s stay as they were."""
    p = p.astype(float).tolist()
    s = s.tolist()
    draws = rng.random(len(p) + 8).tolist()
    active: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) == 3 or len(active) == 2 and s[active[0]] == s[active[1]]:
            a, b = active[0], active[1]
            if len(active) == 2 or s[a] == s[b]:
                steps = ((a, 1.0), (b, -1.0))
            else:
                c = active[2]
                steps = ((a, float(s[c] - s[b])), (b, float(s[a] - s[c])), (c, float(s[b] - s[a])))
            up = down = math.inf
            for k, u in steps:
                if u > 0:
                    up, down = min(up, (1 - p[k]) / u), min(down, p[k] / u)
                elif u < 0:
                    up, down = min(up, p[k] / -u), min(down, (1 - p[k]) / -u)
            by = up if (draws.pop() if draws else rng.random()) * (up + down) < down else -down
            for k, u in steps:
                p[k] += by * u
            left = [k for k in active if EPS < p[k] < 1 - EPS]
            for k in active:
                if k not in left:
                    p[k] = float(round(p[k]))
            active = left
    return np.array(p)


def reserve(p: np.ndarray, s: np.ndarray, n: int = 0) -> np.ndarray:
    """Which undecided documents wait for the landing: up to ``n`` (RESERVE), their sizes spread from half the largest down."""
    out = np.zeros(len(p), bool)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    n = min(n or RESERVE, len(open_))
    if n:
        size = s[open_].astype(float)
        for t in np.geomspace(max(1.0, size.max() / 2), max(1.0, size.min()), n):
            k = int(np.abs(size - t).argmin())
            out[open_[k]], size[k] = True, np.inf
    return out


def _halves(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of each subset of ``s``, which the bits of its place name."""
    bits = (np.arange(1 << len(s))[:, None] >> np.arange(len(s))) & 1
    return bits.sum(axis=1), bits @ s


def land(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Decide the few that are left: as many as expected, rounded down or up, and nearest to the expected words.  Where
    that is further away than NEAR of them, as among a handful of documents, the number may differ by more."""
    out = np.round(p)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(open_):
        return out
    open_ = open_[np.argsort(-s[open_], kind="stable")]
    left, right = open_[::2], open_[1::2]
    (many, words), (many_r, words_r) = _halves(s[left]), _halves(s[right])
    want, want_words = float(p[open_].sum()), float((p * s)[open_].sum())
    best = (np.inf, np.inf, 0, 0)
    by_many = {k: (at := np.flatnonzero(many_r == k))[np.argsort(words_r[at], kind="stable")] for k in np.unique(many_r).tolist()}
    for slack in range(len(open_) + 1):  # of documents; none unless the words would be far off
        for total in {math.floor(want + EPS) - slack, math.ceil(want - EPS) + slack}:
            for k, at in by_many.items():
                mine = np.flatnonzero(many == total - k)
                if not len(mine):
                    continue
                near = np.searchsorted(words_r[at], want_words - words[mine])
                for shift in (-1, 0):
                    other = at[np.clip(near + shift, 0, len(at) - 1)]
                    over = np.abs(words[mine] + words_r[other] - want_words)
                    i = int(over.argmin())
                    best = min(best, (float(over[i]), abs(total - want), int(mine[i]), int(other[i])))
        if best[0] <= max(1.0, NEAR * want_words):
            break
    for which, mask in ((left, best[2]), (right, best[3])):
        out[which] = (mask >> np.arange(len(which))) & 1
    return out


def _fly(seed: int, level: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("unit", "ascending")])
        rng = np.random.default_rng([seed, level, t.column("rank")[0].as_py(), t.column("block")[0].as_py()])
        size, p = t.column("size").to_numpy(), t.column("p").to_numpy().copy()
        flown = ~reserve(p, size) if last else np.ones(len(p), bool)
        p[flown] = flight(p[flown], size[flown], rng)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(land(p, size) if last else p))

    return run


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """rank, source, n, source_size and target of each source.  There may be many sources: they are ranked by ranges,
    each of which is counted, and the ranges before it are added."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    per = cut(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    span, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # One row for each range: spark.sql.shuffle.partitions at most.
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = per.groupBy(span.alias("span")).agg(F.count("*").alias("many")).select("span", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    per = per.withColumn("span", span).join(F.broadcast(spans), "span").withColumn("rank", F.col("before") + inside).drop("span", "before", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = cut(per.withColumn("weight", weight), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    share, was = 0.0, -1
    # Each round stops more sources; with none above its bound, the shares are final.
    while True:
        held = F.col("source_size") * float(most) <= F.col("weight") * share
        row = per.agg(
            F.sum(F.when(held, F.col("source_size") * float(most)).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))), F.sum(held.cast("int"))
        ).first()
        if row[2] is None or row[2] == was or not row[1]:
            break
        share, was = (total - row[0]) / row[1], row[2]
    target = F.when(held, F.col("source_size") * float(most)).otherwise(F.col("weight") * share)
    return per.select("rank", "source", "n", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, h (a hash of its text and source), size, source_size, target and copies (how often it is taken) of
    each row of ``docs`` (doc_id, source, text)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text", F.col("source").cast("string")).alias("h"), "text")
    return _mixed(docs.mapInArrow(_sizes, "doc_id long, source string, h long, size long"), weights, most, seed)


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """The rows of the mix, with all columns of ``docs``: each as often as it is taken."""
    i, h, n, times, copy = fresh(docs.columns, "__id", "__h", "__n", "__times", "__copy")
    same = Window.partitionBy(i, h).orderBy(F.lit(0))  # tells rows of an id apart that agree in source and text
    mine = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64("text", F.col("source").cast("string")))
    mine = mine.withColumn(n, F.row_number().over(same)).alias("d")
    units = mix(docs, weights, most, seed).select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("copies").cast("int").alias(times))
    units = units.withColumn(n, F.row_number().over(same)).filter(F.col(times) > 0).alias("u")
    rows = mine.join(units, F.col(f"d.{i}").eqNullSafe(F.col(f"u.{i}")) & (F.col(f"d.{h}") == F.col(f"u.{h}")) & (F.col(f"d.{n}") == F.col(f"u.{n}")))
    return rows.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(f"u.{times}"))).alias(copy)).drop(copy)


def _mixed(sizes: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    sizes = cut(sizes.withColumn("unit", F.monotonically_increasing_id()), "sizes")
    goal = targets(sizes, weights, most)
    largest = goal.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sizes.join(goal, sizes.source.eqNullSafe(goal.source)).select(
        "unit", "doc_id", "h", sizes.source, "size", "rank", "n", "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p")
    )
    blocks = max(1, math.ceil(largest / BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("long")
    flown = "unit long, doc_id long, size long, rank long, block long, p double"
    level, done = 0, []
    fly = units.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).select("unit", "doc_id", "size", "rank", block.alias("block"), "p")
    while True:
        after = cut(fly.groupBy("rank", "block").applyInArrow(_fly(seed, level, blocks == 1), flown), "flight")
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(after.filter(~open_).select("unit", "p"))
        if blocks == 1:
            break
        fly = after.filter(open_).withColumn("block", F.floor(F.col("block") / F.lit(MERGE)))
        level, blocks = level + 1, math.ceil(blocks / MERGE)
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    extra = F.coalesce(decided["p"], F.round(units["p"])).cast("long")
    return units.join(decided, "unit", "left").select("doc_id", "source", "h", "size", "source_size", "target", (F.col("base") + extra).alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
