"""Words, word hashes and n-gram hashes of UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 200_000
U64 = np.uint64


class WordHash(dict):
    """word -> 64-bit hash, remembering at most about ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words (none if there are fewer)."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, U64)
    for i in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + h[i : i + count]
    return mix(out)


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct ``n``-word shingles, sorted; with fewer words, the whole sequence as one."""
    if len(h) == 0:
        return h
    return np.unique(ngrams(h, n) if len(h) >= n else ngrams(h, len(h)) ^ U64(len(h)))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and the ``n + 1`` places where the texts begin and end."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds (0 where they are equal)."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=np.int64)
    return out


def as_list(words) -> list[bytes]:
    """A string array of words as bytes; faster than ``to_pylist`` because words hold no space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, " ").cast(pa.binary())[0].as_py().split(b" ")


PLAIN_BYTES = np.full(256, 32, np.uint8)
PLAIN_BYTES[48:58] = np.arange(48, 58)
PLAIN_BYTES[65:91] = np.arange(97, 123)
PLAIN_BYTES[97:123] = np.arange(97, 123)
PLAIN_BYTES[128:] = np.arange(128, 256)


def plain_words(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of ASCII letters (lower-cased), digits and other bytes above 127; all else separates.  Gives the
    different words of the batch, the number of each word in order, and the bounds of the texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, bounds = text_bytes(pc.fill_null(texts, ""))
    text = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(PLAIN_BYTES[data]))
    words = pc.ascii_split_whitespace(text)
    found = words.flatten().dictionary_encode()
    unique = as_list(found.dictionary)
    ids = found.indices.to_numpy()
    real = np.ones(len(unique), bool)
    if b"" in unique:
        real[unique.index(b"")] = False
    keep = real[ids]
    ends = np.concatenate([[0], np.cumsum(keep)])[words.offsets.to_numpy()]
    return unique, ids[keep], ends
