"""Operator 9, line deduplication by a deletion-neighbourhood join.

A line of at least ``MIN_WORDS`` words goes if an earlier line, by (doc_id, line number), is equal to it or, where
both have ``NEAR_WORDS`` words or more, one word edit away (a word put in, taken out or replaced), whatever their
length.  Words are compared without the case of A-Z.  From ``NEAR_WORDS`` = 5 words up an edit leaves four fifths
of the words or more; in shorter lines it would make another line ("Chapter 1", "Chapter 2"), so they must be equal.

Two lines one word edit apart share either the words before the middle of the shorter one or those after it.  So
each line first emits a hash of itself and one of each half, as the shorter and as the longer line of a pair: five
keys, however long it is.  Only lines that share a half with a different line emit the deletion neighbourhood: a
hash of all words, and one for each word left out, with that word's place.  Lines that meet under a key at the same
place differ by a replacement, a whole line and a shortened one by a word put in: so within a key the earliest line
decides, and no pairs are made.

What one batch can settle is settled before the shuffle, so a line, a half or a deletion that a third of the rows
share sends a row or two for each batch, not for each line: of equal lines (by two 64-bit hashes) only the first goes
on, and if they repeat, only where it is before those of its task's batches so far; lines that share a half with
another one of their batch are known to, and two of them stand for all; of lines that meet under a deletion at one
place only the first goes on.  A line and the earlier one that it was matched with by an edit are compared again in
full, word by word, before it is dropped, which rules out collisions.

Blank lines stay, as do all lines of null ids; null texts stay null.  Rows that share an id count as one document.  An empty table gives no rows.  Columns other than
text are passed through; ``n_lines`` and ``n_dropped`` are added (or replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, cut, fresh, pieces, raw, ship, table
from .words import U64, as_list, mix, sums, text_bytes

MIN_WORDS, NEAR_WORDS = 1, 5
HALF, WHOLE, KNOWN, SURE = 0, -1, -2, -3  # places: half a line; nothing left out; matched, or sharing a half, within its batch
REMEMBER = 100_000  # repeated lines that a task remembers
BASE = U64(0x9E3779B97F4A7C15)
OTHER = U64(0xD1B54A32D192ED03)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.ones(max(n, 1), U64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _terms(h: np.ndarray, starts: np.ndarray, count: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Terms of the lines' polynomial hashes, one for each word."""
    return h * powers[np.arange(len(h)) - np.repeat(starts, count)]


def _key(value: np.ndarray, length: np.ndarray, tag: int = 0) -> np.ndarray:
    return mix(value + length.astype(np.uint64) * U64(0xD6E8FEB86659FD93) + U64(tag * 0xA0761D6478BD642F % (1 << 64)))


def half_keys(upto: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the halves of lines, whose terms have the sums ``upto``: as the shorter line of a pair, and as
    the one with a word more."""
    inverse = _powers(int(count.max()) + 1, INVERSE)
    line, key = [], []
    for more in (0, 1):
        at = np.flatnonzero(count - more >= NEAR_WORDS)
        first, n, length = starts[at], count[at], count[at] - more
        half = length // 2
        rest = n - (length - half)
        line += [at, at]
        key += [_key(upto[first + half] - upto[first], length, 1), _key((upto[first + n] - upto[first + rest]) * inverse[rest], length, 2)]
    return np.concatenate(line), np.concatenate(key)


def deletion_keys(h: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place) of the whole lines and of each word left out."""
    term = _terms(h, starts, count, _powers(int(count.max()) + 1))
    line = np.repeat(np.arange(len(starts)), count)
    upto = np.cumsum(term)
    before = upto - term - np.repeat((upto - term)[starts], count)
    total = np.add.reduceat(term, starts)
    short = before + (total[line] - before - term) * INVERSE
    return (
        np.concatenate([np.arange(len(starts)), line]),
        np.concatenate([_key(total, count), _key(short, count[line] - 1)]),
        np.concatenate([np.full(len(starts), WHOLE), np.arange(len(h)) - starts[line]]),
    )


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines in a row; each line's first word, text and number."""
    data, bounds = text_bytes(pc.fill_null(texts, ""))
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(bounds, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(doc, doc, side="left")
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1]
    edge = starts[starts > 0]
    first[edge] = ~space[edge]
    count = sums(first, np.append(starts, len(data)))
    text = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(lower))
    found = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    unique = as_list(found.dictionary)
    ids = found.indices.to_numpy()
    if b"" in unique:
        ids = ids[ids != unique.index(b"")]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), U64, len(unique))[ids]
    return h, np.cumsum(count) - count, count, np.stack([doc, number])


def _rows(key, place, check, at, match=None) -> pa.RecordBatch:
    """``at`` and ``match``: (doc_id, line_no) of lines; rows without match come last."""
    few = 0 if match is None else len(match[0])
    pad = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(key) - few, pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(check.view(np.int64)), pa.array(at[0], pa.int64()), pa.array(at[1].astype(np.int32))]
        + [pad(match[0] if few else []), pad(match[1] if few else []).cast(pa.int32())],
        ["key", "place", "check", "doc_id", "line_no", "m_doc", "m_line"],
    )


KEYS = "key long, place int, check long, doc_id long, line_no int, m_doc long, m_line int"


def _heads(*keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that ``order`` sorts by the keys: whether each is the first with its keys, and the place of that first one."""
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return first, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)


def _unique_keys(doc_id: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(doc_id.astype(np.uint64) * BASE + number.astype(np.uint64))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("line_dedup")
    seen: dict[tuple[int, int], tuple[int, int]] = {}  # the first of lines that repeat
    for part in pieces(batches, "text"):
        part = part.filter(pc.is_valid(part.column("doc_id")))
        if not part.num_rows:
            continue
        h, first, count, (doc, number) = _lines(part.column("text"))
        doc_id = part.column("doc_id").to_numpy()[doc]
        long = np.flatnonzero(count >= MIN_WORDS)
        if not len(long):
            continue
        powers, exact, check = _powers(int(count.max()) + 1), np.zeros(len(count), U64), np.zeros(len(count), U64)
        upto = np.concatenate([np.zeros(1, U64), np.cumsum(_terms(h, first, count, powers))])
        exact[long] = _key(upto[first[long] + count[long]] - upto[first[long]], count[long])
        other = np.concatenate([np.zeros(1, U64), np.cumsum(_terms(mix(h), first, count, _powers(len(powers), OTHER)))])
        check[long] = _key(other[first[long] + count[long]] - other[first[long]], count[long], 3)
        # Of equal lines of the batch the first goes on.
        order = long[np.lexsort((number[long], doc_id[long], check[long], exact[long]))]
        new, at = _heads(exact, check, order=order)
        head = order[at]
        again = ~new & ((doc_id[order] != doc_id[head]) | (number[order] != number[head]))
        line, match = order[again], (doc_id[head[again]], number[head[again]])
        fresh = np.ones(len(order), bool) & new
        for i in np.unique(at[again]).tolist():  # lines that repeat: only if before those seen so far
            k, here = (int(exact[order[i]]), int(check[order[i]])), (int(doc_id[order[i]]), int(number[order[i]]))
            before = seen.get(k)
            if before is not None and before <= here:
                fresh[i] = False
                if before < here:
                    line, match = np.append(line, order[i]), (np.append(match[0], before[0]), np.append(match[1], before[1]))
            elif before is not None or len(seen) < REMEMBER:
                seen[k] = here
        fresh = np.sort(order[fresh])
        if len(fresh):
            half, key = half_keys(upto, first[fresh], count[fresh])
        else:
            half, key = np.zeros(0, np.int64), np.zeros(0, U64)
        # Of lines that share a half the first and the last stand for all; those between know that there are others.
        turn = np.lexsort((half, key))
        start, _ = _heads(key, order=turn)
        end = np.append(start, True)[1:]
        sure = np.unique(half[turn][~start & ~end])
        half, key = half[turn][start | end], key[turn][start | end]
        known = np.repeat([KNOWN, SURE, WHOLE, HALF], [len(line), len(sure), len(fresh), len(half)])
        line = np.concatenate([line, fresh[sure], fresh, fresh[half]])
        alone = len(line) - len(fresh) - len(half)
        keys = np.concatenate([_unique_keys(doc_id[line[:alone]], number[line[:alone]]), exact[fresh], key])
        yield _rows(keys, known, check[line], (doc_id[line], number[line]), match)


def _emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("line_dedup")
    for part in pieces(batches, "l_text", 1 << 20):
        h, first, count, (row, _) = _lines(part.column("l_text"))
        if not len(count):
            continue
        doc_id, number = (part.column(c).to_numpy()[row] for c in ("l_doc", "l_line"))
        line, key, place = deletion_keys(h, first, count)
        rank = np.empty(len(doc_id), np.int64)
        rank[np.lexsort((number, doc_id))] = np.arange(len(doc_id))
        # Of lines that meet under a key at one place the first goes on; it is a match of the others.
        order = np.lexsort((rank[line], place, key))
        new, at = _heads(key, place, order=order)
        later, head = line[order[~new]], line[order[at[~new]]]
        turn = np.lexsort((rank[head], later))
        best, _ = _heads(later, order=turn)
        later, head = later[turn][best], head[turn][best]
        go = np.sort(order[new])
        at = np.concatenate([later, line[go]])
        keys = np.concatenate([_unique_keys(doc_id[later], number[later]), key[go]])
        places = np.concatenate([np.full(len(later), KNOWN), place[go]])
        yield _rows(keys, places, np.zeros(len(at), U64), (doc_id[at], number[at]), (doc_id[head], number[head]))


def one_edit(x: list, y: list) -> bool:
    """Whether two sequences are equal or one insertion, deletion or replacement apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def alike(x: bytes, y: bytes) -> bool:
    """Whether two lines are equal or, if long enough, one word edit apart."""
    a, b = x.lower().split(), y.lower().split()
    return a == b or min(len(a), len(b)) >= NEAR_WORDS and one_edit(a, b)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text", 1 << 20):
        ids, numbers, texts = [], [], []
        for d, t, wanted in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), part.column("wanted").to_pylist()):
            rows = (t or b"").split(b"\n")
            for k in wanted:
                if k < len(rows):
                    ids.append(d)
                    numbers.append(k)
                    texts.append(rows[k])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], ["l_doc", "l_line", "l_text"])


def _rewrite(lines: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            out, n_lines, n_dropped = [], [], []
            for t, found in zip(raw(part.column("text")), part.column(lines).to_pylist()):
                rows = t.split(b"\n") if t is not None else []
                gone = {f["line_no"] for f in found or () if f["line_no"] < len(rows) and (not f["near"] or (f["l_text"] is not None and alike(rows[f["line_no"]], f["l_text"].encode())))}
                out.append(b"\n".join(r for i, r in enumerate(rows) if i not in gone) if gone else t)
                n_lines.append(len(rows))
                n_dropped.append(len(gone))
            columns = {n: part.column(n) for n in part.schema.names if n != lines}
            columns |= {"text": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with an equal earlier one, lines with one a word edit away, and the texts of the latter's candidates."""
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at, known, whole = F.struct("doc_id", "line_no"), F.col("place") == KNOWN, F.col("place") == WHOLE
    within = F.struct(F.col("m_doc").alias("doc_id"), F.col("m_line").alias("line_no"))
    keys = ids.mapInArrow(_emit, KEYS).withColumn("at", at)
    keys = keys.withColumn("first", F.min("at").over(Window.partitionBy("key", "check")))
    by_key = Window.partitionBy("key")
    keys = keys.withColumn("differ", F.min("check").over(by_key) != F.max("check").over(by_key))
    equal = known | whole & (F.col("first") < F.col("at"))
    first = F.when(known, within).when(whole & (F.col("first") < F.col("at")), F.col("first"))
    keys = keys.filter(equal | (F.col("place") == SURE) | (F.col("place") == HALF) & F.col("differ")).select("doc_id", "line_no", first.alias("first"))
    lines = cut(keys.groupBy("doc_id", "line_no").agg(F.min("first").alias("first")), "lines")
    same = lines.filter("first is not null").select("doc_id", "line_no", F.lit(False).alias("near"), F.col("first.doc_id").alias("l_doc"), F.col("first.line_no").alias("l_line"))

    wanted = lines.filter("first is null").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list("line_no").alias("wanted"))
    texts = ids.join(wanted, F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "wanted")
    texts = cut(texts.mapInArrow(_fetch, "l_doc long, l_line int, l_text string"), "texts")
    keys = texts.mapInArrow(_emit_words, KEYS).withColumn("at", at)
    keys = (
        keys.withColumn("same", F.min("at").over(Window.partitionBy("key", "place")))
        .withColumn("equal", F.min(F.when(whole, F.col("at"))).over(by_key))
        .withColumn("any", F.min("at").over(by_key))
    )
    match = F.when(known, within).when(whole, F.col("any")).otherwise(F.least("same", "equal"))
    near = keys.select("doc_id", "line_no", "at", match.alias("match")).filter(F.col("match") < F.col("at")).groupBy("doc_id", "line_no").agg(F.min("match").alias("match"))
    near = near.select("doc_id", "line_no", F.lit(True).alias("near"), F.col("match.doc_id").alias("l_doc"), F.col("match.line_no").alias("l_line"))
    return same, near, texts


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no of every line with an earlier match, one such match (l_doc, l_line), and near: whether it
    differs from the line."""
    same, near, _ = _found(docs)
    return same.unionByName(near)


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that are left, n_lines (before) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    same, near, texts = _found(docs)
    near = near.join(texts, ["l_doc", "l_line"]).select("doc_id", "line_no", "near", "l_text")
    every = same.select("doc_id", "line_no", "near", F.lit(None).cast("string").alias("l_text")).unionByName(near)
    doc, lines = fresh(docs.columns, "__doc", "__found")
    by_doc = every.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("line_no", "near", "l_text")).alias(lines))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return docs.join(by_doc, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc).mapInArrow(_rewrite(lines), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the crc32 of the text left, of every document."""
    out = drop_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
