"""Operator 5, quality rules: line sequence labelling with a linear-chain conditional random field.

Each line with a word is an item of its document's sequence, described by a dozen shares and lengths
(symbols, capitals, digits, punctuation, word and line length, repeated words and lines).  Viterbi decoding marks the
lines as content or boilerplate; a document is kept if at least ``SHARE`` of its words stand in content
lines, and the base rules do not fail it.

Labels are known for documents only, so the field is fitted by alternating: lines start with the label of
their document; then the field is fitted (forward-backward gradients) and the lines of bad documents are
decoded anew, keeping boilerplate where at least one line is.  It is fitted on at most ``SAMPLE`` labelled
documents of each quality, those with the smallest hashes of their ids, without texts above ``EXAMPLE_BYTES``; everything else covers all rows.

Null, empty and wordless texts have no words and fail the base rules.  Without labels of both kinds every
line counts as content.  Repeated rows get equal results; null ids are passed through; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EXAMPLE_BYTES, claim, pieces, ship, table
from .words import U64, mix, sums, text_bytes

SAMPLE = 1500
SHARE = 0.5
ENOUGH = 5e-3  # the steepest slope at which fitting ends
WINDOW = 24  # lines of a training sequence
SPACE, START, SYMBOL, UPPER, LOWER, DIGIT, MARK = (1 << i for i in range(7))
CLASS = np.zeros(256, np.uint8)
CLASS[[32, *range(9, 14)]] = SPACE
CLASS[[i for i in range(256) if i & 0xC0 != 0x80 and not CLASS[i] & SPACE]] |= START  # of a code point in a word
for _chars, _bit in ((b"#*$%&|<>", SYMBOL), (bytes(range(65, 91)), UPPER), (bytes(range(97, 123)), LOWER), (b"0123456789", DIGIT), (b"!?.,:;-'\"()[]{}@/\\_=+~^`", MARK)):
    CLASS[list(_chars)] |= _bit
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, kept boolean"


@dataclass
class Field:
    """Weights of the features for content against boilerplate, and of the steps between labels."""

    weights: np.ndarray
    steps: np.ndarray  # [from, to]; 1 is content
    prior: float = 0.0  # for content in the first line: how much commoner good documents are than in the sample


def repeats(ids: np.ndarray, bounds: np.ndarray, n: int = 5) -> np.ndarray:
    """For each document, its words inside windows of ``n`` words that it holds twice or more."""
    total = len(ids)
    covered = np.zeros(total + 1, np.int64)
    if total >= n:
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
        h = mix(ids.astype(np.uint64) + U64(1))
        g = np.zeros(len(at), np.uint64)
        for i in range(n):
            g = g * U64(0x9E3779B97F4A7C15) + h[at + i]
        g = mix(g) ^ mix(doc[at].astype(np.uint64) + U64(0x1234567))
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    return sums((np.cumsum(covered)[:-1] > 0).astype(np.int64), bounds)


@dataclass
class Measured:
    """The measures of a batch, and its lines that have words: document, words and features of each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measure(texts: pa.Array) -> Measured:
    texts = pc.fill_null(texts, "")
    data, bounds = text_bytes(texts)
    kind = CLASS[data]
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    word_bounds = np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
    found = flat.dictionary_encode()
    ids = found.indices.to_numpy()[real]
    n_words = np.diff(word_bounds)

    # Lines end at \n and at the end of their text.
    breaks = np.flatnonzero(data == 10)
    # 0: a text begins here; a text of no bytes has one line of no bytes, which holds no word.
    starts = np.unique(np.concatenate([breaks + 1, bounds[:-1][np.diff(bounds) > 0]])).astype(np.int64)
    starts = starts[starts < len(data)]
    lines = np.append(starts, len(data))
    space = (kind & SPACE) > 0
    first = ~space
    first[1:] &= space[:-1]
    inner = starts[starts > 0]
    first[inner] = ~space[inner]
    n = sums(first, lines)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    has = n > 0

    def count(bit: int) -> np.ndarray:
        return sums((kind & bit) > 0, lines)

    upper, lower, digit, mark, symbol, chars = (count(b) for b in (UPPER, LOWER, DIGIT, MARK, SYMBOL, START))
    doc, n, upper, lower, digit, mark, symbol, chars = (x[has] for x in (doc, n, upper, lower, digit, mark, symbol, chars))
    raw_text = data.tobytes()
    ends = lines[1:][has]
    again, dup, seen, last = np.zeros(len(n), bool), np.zeros(len(texts), np.int64), set(), -1
    for i, (d, a, b) in enumerate(zip(doc.tolist(), lines[:-1][has].tolist(), ends.tolist())):
        if d != last:
            seen, last = set(), d
        line = raw_text[a:b].removesuffix(b"\n")
        if line in seen:
            again[i] = True
            dup[d] += 1
        seen.add(line)
    c = np.maximum(chars, 1)
    letters = np.maximum(upper + lower, 1)
    other = c - upper - lower - digit - mark - symbol  # letters beyond ASCII, mostly
    stop = np.zeros(len(n))
    if len(n):
        tail = data[np.maximum(ends - 1, 0)]
        tail = np.where(tail == 10, data[np.maximum(ends - 2, 0)], tail)
        stop = np.isin(tail, list(b".!?")).astype(float)
    length = np.log2(n + 1)
    line_of = np.repeat(np.arange(len(n)), n)
    echo = np.zeros(len(n))
    if len(ids) > 1:  # words equal to the one before them
        echo = np.bincount(line_of[1:], (ids[1:] == ids[:-1]) & (line_of[1:] == line_of[:-1]), len(n))
    plain = (symbol <= 0.1 * n) & (upper <= 0.5 * letters) & (mark <= 0.6 * n) & (digit <= 0.3 * c) & (echo <= 0.1 * n) & ~again
    features = np.stack(
        [
            np.ones(len(n)), np.minimum(length / 8, 1), (n <= 3).astype(float), np.minimum(c / n / 12, 1.5), upper / letters, np.minimum(symbol / n, 1.5),
            symbol / c, np.minimum(mark / n, 1.5), mark / c, digit / c, stop, again.astype(float), np.maximum(other, 0) / c, ((upper > 0.6 * letters) & (n > 2)).astype(float), plain.astype(float), echo / np.maximum(n, 1),
        ],
        axis=1,
    )
    return Measured(n_words, sums((kind & START) > 0, bounds), sums((kind & SYMBOL) > 0, bounds), dup, repeats(ids, word_bounds), doc, n, features)


def sequences(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each run of one document."""
    first = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(doc)))


def viterbi(field: Field, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best labels (1: content) of all lines, all documents side by side."""
    out = np.ones(len(doc), np.int8)
    if not len(doc):
        return out
    first, count = sequences(doc)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    gain = features @ field.weights
    score = np.zeros((len(first), 2))
    score[:, 1] = gain[first] + field.prior
    back: list[np.ndarray] = []
    for t in range(1, int(count[0])):
        live = int(np.searchsorted(-count, -t, side="left"))
        s = score[:live]
        zero, one = s[:, :1] + field.steps[0], s[:, 1:] + field.steps[1]
        back.append(one > zero)
        s = np.maximum(zero, one)
        s[:, 1] += gain[first[:live] + t]
        score[:live] = s
    state = (score[:, 1] > score[:, 0]).astype(np.int8)
    for t in range(int(count[0]) - 1, -1, -1):
        live = int(np.searchsorted(-count, -t, side="left"))
        out[first[:live] + t] = state[:live]
        if t:
            state[:live] = back[t - 1][np.arange(live), state[:live]]
    return out


def fit_field(features: np.ndarray, doc: np.ndarray, good: np.ndarray, rounds: int = 3, steps: int = 120) -> Field:
    """``good``: for each line, whether its document is."""
    d = features.shape[1] if features.ndim == 2 else 1
    field = Field(np.zeros(d), np.zeros((2, 2)))
    if not len(doc) or good.all() or not good.any():
        field.weights[0] = 50.0
        return field
    first, count = sequences(doc)
    cuts = [(a + k, min(WINDOW, n - k)) for a, n in zip(first.tolist(), count.tolist()) for k in range(0, n, WINDOW)]
    begin, size = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
    at = np.minimum(begin[:, None] + np.arange(WINDOW), len(doc) - 1)
    mask = np.arange(WINDOW) < size[:, None]
    labels = good.astype(np.int8)
    for r in range(rounds):
        y = labels[at]
        w, m, v = np.concatenate([field.weights, field.steps.ravel()]), 0.0, 0.0
        pairs = mask[:, 1:]
        # What the labels have of each feature and step.
        seen = np.concatenate([(features[at] * (y * mask)[..., None]).sum((0, 1)), np.bincount((y[:, :-1] * 2 + y[:, 1:])[pairs], minlength=4)])
        for step in range(1, steps + 1):
            gain, turn = features @ w[:d], w[d:].reshape(2, 2)
            e = np.zeros((len(at), WINDOW, 2))
            e[..., 1] = gain[at]
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0]
            for t in range(1, WINDOW):
                new = np.logaddexp(forward[:, t - 1, :1] + turn[0], forward[:, t - 1, 1:] + turn[1]) + e[:, t]
                forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
            for t in range(WINDOW - 2, -1, -1):
                after = e[:, t + 1] + backward[:, t + 1]
                new = np.logaddexp(after[:, :1] + turn[:, 0], after[:, 1:] + turn[:, 1])
                backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
            z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            content = np.exp(forward[..., 1] + backward[..., 1] - z[:, None]) * mask
            joint = np.exp(forward[:, :-1, :, None] + turn + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
            expected = np.concatenate([np.bincount(at.ravel(), content.ravel(), len(doc)) @ features, joint.sum((0, 1)).ravel()])
            g = (seen - expected) / len(at) - 1e-3 * w
            if np.abs(g).max() < ENOUGH:
                break
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field = Field(w[:d], w[d:].reshape(2, 2))
        decoded = viterbi(field, features, doc)
        bad_lines = np.bincount(doc, decoded == 0)[doc]  # a bad document keeps its labels where none of its lines is boilerplate
        labels = np.where(good, 1, np.where(bad_lines > 0, decoded, 0)).astype(np.int8)
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` documents of each quality of ``labels`` (doc_id, quality)."""
    chosen = None
    for q in (0, 1):
        part = labels.filter(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample rows are broadcast and collected.
    rows = {r.quality: r["count"] for r in labels.filter(F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= EXAMPLE_BYTES)
    got = short.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").toArrow()
    if not got.num_rows:
        return fit_field(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, bool))
    text = got.column("text").combine_chunks()
    x = measure(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
    good = got.column("quality").to_numpy() == 1
    field = fit_field(x.features, x.doc, good[x.doc])
    if rows.keys() == {0, 1} and 0 < good.sum() < len(good):
        field.prior = float(np.log(rows[1] / rows[0] / (good.sum() / (~good).sum())))
    return field


def _judge(field: Field, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for part in pieces(batches, "text"):
            x = measure(part.column("text"))
            label = viterbi(field, x.features, x.doc) if x.features.shape[1] == len(field.weights) else np.ones(len(x.doc), np.int8)
            content = np.bincount(x.doc, x.words * label, part.num_rows).astype(np.int64)
            failed = (x.n_words < 10) | (100 * x.n_repeat_words > 20 * x.n_words)
            kept = ~failed & (content >= share * x.n_words)
            columns = [part.column("doc_id"), *(pa.array(c) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, content, kept))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def judge(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The measures and the verdict on each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge(field, share), RESULT)


def _filter(field: Field, share: float):
    verdict = _judge(field, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            keep = next(verdict(iter([part]))).column("kept")
            yield part.filter(keep)

    return run


def keep_good(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; no shuffle."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_filter(field, share), docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures, base_failed, content_words and kept of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
