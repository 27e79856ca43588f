"""Operator 4, token ids in ORC files.

Documents are dealt out by ranges of doc_id and sorted there, encoded, and written as ORC: one row for a
document, its ids as a list of integers, which ORC's writer run-length encodes; each stripe has row
indexes and a Bloom filter on doc_id.  So a reader of some documents skips stripes and row groups by
their statistics, and a reader of all takes stripes in parallel.  Every row carries the number of its
block (one for each range) and the ids before it in that block; the block totals, read from a column of
its own, give the place of every document among all ids.

Null text is encoded as an empty one.  Null doc_ids come first.  Rows with one doc_id stand next to each
other, by text.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, shared_path, ship, table
from .tokens import ENCODED_BYTES, encoder, vocabulary

ROW = "doc_id long, block int, block_start long, n_tokens int, ids array<int>"
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 2_000


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for part in pieces(batches, "text", ENCODED_BYTES):
            flat, ends = enc.encode(part.column("text"))
            ends = np.concatenate([[0], ends])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.full(len(ends) - 1, block, np.int32)),
                    pa.array(ends[:-1] + done),
                    pa.array(np.diff(ends).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))),
                ],
                ["doc_id", "block", "block_start", "n_tokens", "ids"],
            )
            done += int(ends[-1])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the ids of all ``docs`` (doc_id, text) to ORC files at ``path``, in ascending doc_id order."""
    ship(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    (
        ordered.mapInArrow(_encode(tokenizer_path), ROW)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("compression", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in the files."""
    return _placed(spark.read.schema(ROW).orc(path), spark.read.schema(ROW).orc(path)).drop("block")


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with start, the ids of all documents before each, for block_start."""
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each block, of which there are as many as write tasks: spark.sql.shuffle.partitions at most.
    bases = files.groupBy("block").agg(F.sum("n_tokens").alias("total")).select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "block").withColumn("start", F.col("base") + F.col("block_start")).drop("base", "block_start")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; statistics and Bloom filters prune stripes and row groups."""
    return spark.read.schema(ROW).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        view = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("block"), batch.column("block_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "block", "block_start", "n_tokens", "ids_crc32"],
        )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ORC files read back."""
    path = shared_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary())
    files = spark.read.schema(ROW).orc(path)
    digests = files.select("doc_id", "block", "block_start", "ids").mapInArrow(_digest, "doc_id long, block int, block_start long, n_tokens long, ids_crc32 long")
    return _placed(digests, files).select("doc_id", "start", "n_tokens", "ids_crc32")
