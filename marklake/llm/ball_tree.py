"""Operator 7, exact search for the highest inner products by ball trees.

Vectors are dealt to cells by the nearest of up to ``CELLS`` centres, which come from a ball tree over a sample of at
most ``SAMPLE`` vectors; a cell of more than ``SHARD`` rows is dealt to shards by a hash, so copies of one vector fill
no task.  Each shard has a tree of balls: a node has the centre and the radius of its vectors and is split at the
median along the line between two far ones.  For a query q no vector of a node has a higher product than
q.centre + |q| * radius.  A block of queries walks a shard's tree together: first each query looks into the leaf with
its highest bound; then nodes are visited by descending bound, by those queries only whose current k-th score the
bound reaches (ties included).

The k-th scores are shared between shards: every block, of queries of one cell, is first searched in one shard of
its cell.  Then the bounds of the cells, of which there are ``CELLS`` at most, decide which of its queries go to which
other cells at all; only those are sent.  A shard's tree stays in its task, and the blocks stream past it.  Each shard
gives at most k candidates for a query, and the k best of these are the result.

Vectors that are null, or hold a null or a component that isn't finite, take no part, nor do null ids.
Shorter vectors count as padded with zeros.  Rows that share the query's id are its own; of repeated query
rows the one with the smallest vector asks.  Ties go to the smaller id.  Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship, table

SHARD, LEAF, QUERIES = 8192, 48, 256
CELLS, SAMPLE = 256, 4096
SCALE = 256
LONG = np.iinfo(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                ids.append(i)
                out.append(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])


def _matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    width = max([width, *(len(r) // 8 for r in rows)])
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<f8")
    return out


def _pad(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def upper_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No product of a query with a vector of a ball is higher; rounding is allowed for."""
    with np.errstate(all="ignore"):
        bound = q @ centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * radii
        bound = bound + 1e-9 * np.abs(bound) + 1e-6
    return np.nan_to_num(bound, nan=np.inf, posinf=np.inf)


def grow(x: np.ndarray, leaf: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, centres, radii, spans): node i holds rows order[spans[i, 0] : spans[i, 1]] and has
    its children at spans[i, 2] and spans[i, 3] (-1: a leaf)."""
    order = np.arange(len(x))
    centres, radii, spans, todo = [], [], [], [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        part = x[order[a:b]]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        if parent >= 0:
            spans[parent][2 + side] = len(spans)
        if b - a > (leaf or LEAF) and away.max() > 0:
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            rank = np.argsort(part @ (other - one), kind="stable")
            order[a:b] = order[a:b][rank]
            middle = (a + b) // 2
            todo += [(a, middle, len(spans), 0), (middle, b, len(spans), 1)]
        centres.append(centre)
        radii.append(away.max())
        spans.append([a, b, -1, -1])
    return order, np.array(centres), np.array(radii), np.array(spans)


class Search:
    """The k best of one shard for a block of queries, given what they reached before."""

    def __init__(self, ids, x, tree, q_ids, q, floor, k):
        order, centres, radii, self.spans = tree
        width = max(x.shape[1], q.shape[1])
        self.ids, self.x, self.q_ids, self.q, self.k = ids[order], _pad(x, width)[order], q_ids, _pad(q, width), k
        self.bound = upper_bounds(self.q, _pad(centres, width), radii)
        self.floor = floor.copy()
        self.score = np.full((len(q), k), LONG.min)
        self.found = np.full((len(q), k), LONG.max)
        self.many = np.zeros(len(q), np.int64)  # how many candidates a query has
        # Products are exact in doubles unless components are huge.
        top = (np.abs(self.x).max(initial=0) + 1) * (np.abs(self.q).max(initial=0) + 1) * max(1, width)
        self.exact = top < 2**53

    def products(self, sel: np.ndarray, a: int, b: int) -> np.ndarray:
        if self.exact:
            return (self.q[sel] @ self.x[a:b].T).astype(np.int64)
        whole = np.frompyfunc(int, 1, 1)
        q, x = whole(self.q[sel]), whole(self.x[a:b])
        return np.array([[min(max(sum(map(int.__mul__, u, v)), LONG.min), LONG.max) for v in x] for u in q], np.int64).reshape(len(q), len(x))

    def leaf(self, node: int, sel: np.ndarray) -> None:
        a, b = self.spans[node, :2]
        s = self.products(sel, a, b)
        own = self.q_ids[sel][:, None] == self.ids[a:b]
        hit = ((s >= self.floor[sel][:, None]) & ~own).any(axis=1)
        sel, s, own = sel[hit], s[hit], own[hit]
        if not len(sel):
            return
        ids = np.where(own, LONG.max, np.broadcast_to(self.ids[a:b], s.shape))
        out = np.concatenate([np.arange(self.k) >= self.many[sel][:, None], own], axis=1)  # empty places and the query itself come last
        scores, ids = np.concatenate([self.score[sel], s], axis=1), np.concatenate([self.found[sel], ids], axis=1)
        best = np.lexsort((ids, ~scores, out), axis=1)[:, : self.k]
        self.score[sel] = np.take_along_axis(scores, best, 1)
        self.found[sel] = np.take_along_axis(ids, best, 1)
        self.many[sel] = np.minimum(self.k, self.many[sel] + (~own).sum(axis=1))
        full = sel[self.many[sel] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])

    def run(self) -> None:
        leaves = np.flatnonzero(self.spans[:, 2] < 0)
        first = leaves[self.bound[:, leaves].argmax(axis=1)]
        for node in np.unique(first).tolist():
            self.leaf(node, np.flatnonzero(first == node))
        todo = [(0, np.arange(len(self.q)))]
        while todo:
            node, sel = todo.pop()
            sel = sel[self.bound[sel, node] >= self.floor[sel]]
            if not len(sel):
                continue
            if self.spans[node, 2] < 0:
                if len(sel := sel[first[sel] != node]):
                    self.leaf(node, sel)
                continue
            # The child of the higher bounds is taken next.
            todo += sorted(((int(c), sel) for c in self.spans[node, 2:]), key=lambda c: self.bound[sel, c[0]].mean())


def _shard(centres: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("vec_id")
        x = _matrix(rows.column("v").to_pylist(), centres.shape[1])
        order, middle, radii, spans = grow(x)
        centre = _pad(centres[t.column("cell")[0].as_py()][None], x.shape[1])
        with np.errstate(over="ignore"):
            reach = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        blob = [rows.column("vec_id").to_numpy().astype("<i8"), x, order.astype("<i8"), middle, radii, spans.astype("<i8")]
        one = {"cell": t.column("cell")[:1], "part": t.column("part")[:1], "rows": [x.shape[0]], "width": [x.shape[1]], "nodes": [len(radii)], "reach": [reach]}
        return pa.table(one | {f"t{i}": pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for i, b in enumerate(blob)})

    return run


SHARDS = "cell int, part int, rows long, width long, nodes long, reach double, " + ", ".join(f"t{i} binary" for i in range(6))


def _route(centres: np.ndarray):
    """The cell of each vector: the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), centres.shape[1])
            c = _pad(centres, x.shape[1])
            with np.errstate(all="ignore"):
                away = np.nan_to_num((c**2).sum(axis=1) - 2 * (x @ c.T), nan=np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(away.argmin(axis=1).astype(np.int32))], ["vec_id", "v", "cell"])

    return run


def _block(t: pa.Table) -> pa.Table:
    rows = t.sort_by("vec_id")
    q = _matrix(rows.column("v").to_pylist())
    blob = {"q_ids": rows.column("vec_id").to_numpy().astype("<i8"), "q": q, "floors": rows.column("floor").to_numpy(zero_copy_only=False).astype("<f8")}
    return pa.table({"home": t.column("home")[:1], "block": t.column("block")[:1], "q_width": [q.shape[1]]} | {n: pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for n, b in blob.items()})


BLOCKS = "home int, block int, q_width long, q_ids binary, q binary, floors binary"


def _queries(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["q_ids"], "<i8")
    return ids, np.frombuffer(r["q"], "<f8").reshape(len(ids), r["q_width"]), np.frombuffer(r["floors"], "<f8")


def _aim(centres: np.ndarray, reach: np.ndarray):
    """Each block again for each cell, with those of its queries that may find something there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q, floors = _queries(r)
                width = max(q.shape[1], centres.shape[1])
                go = upper_bounds(_pad(q, width), _pad(centres, width), reach) >= floors[:, None]
                for cell in np.flatnonzero(go.any(axis=0)).tolist():
                    s = go[:, cell]
                    row = {"cell": cell, "home": r["home"], "block": r["block"], "q_width": q.shape[1], "q_ids": ids[s].tobytes(), "q": q[s].tobytes(), "floors": floors[s].tobytes()}
                    yield pa.RecordBatch.from_pylist([row], _AIMED)

    return run


_AIMED = pa.schema([("cell", pa.int32()), ("home", pa.int32()), ("block", pa.int32()), ("q_width", pa.int64()), ("q_ids", pa.binary()), ("q", pa.binary()), ("floors", pa.binary())])


def _search(k: int):
    """Rows by shard, its tree before the blocks: the tree is held until the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["t0"] is not None:
                    n, w, m = r["rows"], r["width"], r["nodes"]
                    ids, x, order, centres, radii, spans = (np.frombuffer(r[f"t{j}"], kind) for j, kind in enumerate(("<i8", "<f8", "<i8", "<f8", "<f8", "<i8")))
                    at, shard = (r["cell"], r["part"]), (ids, x.reshape(n, w), (order, centres.reshape(m, w), radii, spans.reshape(m, 4)))
                    continue
                if at != (r["cell"], r["part"]):
                    raise ValueError(f"a block for shard {r['cell'], r['part']} met {at}")
                q_ids, q, floors = _queries(r)
                s = Search(*shard, q_ids, q, floors, k)
                s.run()
                got, rank = np.nonzero((np.arange(k) < s.many[:, None]) & (s.score >= floors[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[got]), pa.array(s.found[got, rank]), pa.array(s.score[got, rank])], ["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) where ``asks`` (an
    expression of vec_id) holds, the ``k`` rows of highest inner product of the scaled, floored components."""
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_whole, "vec_id long, v binary"), "vectors")
    n = rows.count()
    cells = min(CELLS, max(1, math.ceil(n / SHARD)))
    centres = np.zeros((1, 0))
    if cells > 1:  # from at most SAMPLE vectors
        sample = _matrix([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()])
        _, middle, _, spans = grow(sample, math.ceil(len(sample) / cells))
        centres = middle[spans[:, 2] < 0][:CELLS]
    routed = cut(rows.mapInArrow(_route(centres), "vec_id long, v binary, cell int"), "routed")
    # At most CELLS rows.
    parts = {r.cell: math.ceil(r.n / SHARD) for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    many = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(centres))]), F.col("cell") + 1)
    dealt = routed.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), many).cast("int"))
    trees = cut(dealt.groupBy("cell", "part").applyInArrow(_shard(centres), SHARDS), "trees")
    queries = routed.filter(asks).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("a")).select("vec_id", "a.v", F.col("a.cell").alias("home"))
    per_home = {r.home: math.ceil(r.n / QUERIES) for r in queries.groupBy("home").agg(F.count("*").alias("n")).collect()}
    blocks = F.element_at(F.array(*[F.lit(per_home.get(c, 1)) for c in range(len(centres))]), F.col("home") + 1)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), blocks).cast("int"))

    def searched(aimed: DataFrame) -> DataFrame:
        """``aimed``: blocks with the cell and part that they go to."""
        met = trees.drop("reach").unionByName(aimed, allowMissingColumns=True).repartition("cell", "part")
        met = met.sortWithinPartitions("cell", "part", F.col("t0").isNull(), "home", "block")
        return met.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    home_part = F.pmod(F.col("block"), many).cast("int")
    first = asked.withColumn("floor", F.lit(-math.inf)).groupBy("home", "block").applyInArrow(_block, BLOCKS)
    first = searched(first.withColumn("cell", F.col("home")).withColumn("part", home_part))
    if sum(parts.values()) <= 1:
        found = first
    else:
        first = cut(first, "first")
        reached = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(-math.inf).alias("floor"))
        # The score as a double may be above the score.
        again = asked.join(reached, "vec_id", "left").withColumn("floor", F.coalesce(F.col("floor") - F.abs("floor") * 1e-15, F.lit(-math.inf)))
        reach = np.zeros(len(centres))
        for r in trees.groupBy("cell").agg(F.max("reach").alias("reach")).collect():  # at most CELLS rows
            reach[r.cell] = r.reach
        aimed = again.groupBy("home", "block").applyInArrow(_block, BLOCKS).mapInArrow(_aim(centres, reach), "cell int, " + BLOCKS)
        aimed = aimed.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).filter((F.col("cell") != F.col("home")) | (F.col("part") != home_part))
        found = first.unionByName(searched(aimed))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every 50th vector with all others."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""
