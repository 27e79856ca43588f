"""Operator 8, cost-balanced packing.

The cost of a piece of n tokens is ``LINEAR * n + QUADRATIC * n * n``: the dense layers and attention.
Full pieces of ``capacity`` tokens are sequences of their own.  The remainders of a block of documents
are packed together, in descending length, each into the sequence of the lowest cost that has room for
all of it; if none has, it is cut: the cheapest sequence with room takes what fits.  The capacities of a
block add up to its tokens exactly: all are ``capacity`` but the last, whose tokens are dealt to
sequences of powers of two.  So no sequence needs padding.

A block is up to ``BLOCK`` consecutive documents of one partition: packing moves no text, needs no
shuffle and holds the remainders of one block only.  A rerun over the same partitions gives the same
sequences; to have them independent of the file layout, repartition by a hash first.

Null text counts as empty: the document is its end id.  Repeated rows are packed one by one.  Ties go to
the earlier row and the earlier sequence.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lists, pieces, ship, table
from .tokens import ENCODED_BYTES, encoder, vocabulary

CAPACITY = 2048
BLOCK = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Room of the sequences for ``total`` tokens: full ones, then powers of two."""
    out = [capacity] * (total // capacity)
    rest, power = total % capacity, 1 << max(0, capacity.bit_length() - 1)
    while rest:
        if rest >= power:
            out.append(power)
            rest -= power
        else:
            power >>= 1
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents of ``lengths`` tokens."""
    room = np.array(capacities(int(lengths.sum()), capacity), np.int64)
    free, cost, out = room.copy(), np.zeros(len(room)), []
    for i in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[i])
        while left:
            best = np.where(free >= left, cost, np.inf)
            k = int(best.argmin())
            if best[k] == np.inf:
                k = int(np.where(free > 0, cost, np.inf).argmin())
            n = min(left, int(free[k]))
            out.append((int(i), start, n, k, int(room[k] - free[k])))
            free[k] -= n
            cost[k] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return out


def _packer(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, next_id = encoder(path), TaskContext.get().partitionId() << 40
        width = np.dtype(enc.kind).itemsize
        held: list[tuple[int | None, bytes, int]] = []  # of each open document: its id, its remainder's ids, where that starts
        rows: list[tuple] = []
        row_ids: list[np.ndarray] = []

        def piece(doc, ids, start, total, seq, offset):
            ids = np.frombuffer(ids, enc.kind).astype("<u4")
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset))
            if with_ids:
                row_ids.append(ids)

        def close():
            nonlocal next_id
            found = pack(np.array([len(x[1]) // width for x in held], np.int64), capacity)
            for i, start, n, k, offset in found:
                doc, ids, before = held[i]
                piece(doc, ids[start * width : (start + n) * width], before + start, before + len(ids) // width, next_id + k, offset)
            next_id += 1 + max((x[3] for x in found), default=-1)
            held.clear()

        def out():
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] + ([lists(row_ids, pa.int32())] if with_ids else [])
            got = pa.RecordBatch.from_arrays(columns, names)
            rows.clear()
            row_ids.clear()
            return got

        for part in pieces(batches, "text", ENCODED_BYTES):
            flat, ends = enc.encode(part.column("text"))
            data, begin = flat.tobytes(), 0
            for doc, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                ids, total = data[begin * width : end * width], end - begin
                begin = end
                full = total // capacity
                for j in range(full):
                    piece(doc, ids[j * capacity * width : (j + 1) * capacity * width], j * capacity, total, next_id, 0)
                    next_id += 1
                if total % capacity:
                    held.append((doc, ids[full * capacity * width :], full * capacity))
                    if len(held) == BLOCK:
                        close()
                if len(rows) >= 2000:
                    yield out()
        if held:
            close()
        if rows:
            yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text), with their ids unless only digests are wanted."""
    ship(docs.sparkSession)
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer_path, capacity, with_ids), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
