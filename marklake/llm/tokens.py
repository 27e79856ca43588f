"""Token ids of whole texts, by the ``tokenizers`` library, through a bounded cache of words.

White space always ends a token of the word-BPE vocabulary (its normalizer folds white space and its
pre-tokenizer drops it), and so does the change from an ASCII letter or digit to a trailing run of
``.,!?:;``.  So the ids of a text are those of its words in order.  Texts in which a special token may
stand (``<|``) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim
from .words import as_list

END_ID = 1
GENERATION = 200_000
ENCODED_BYTES = 8 << 20  # of text at a time; the more, the fewer times a word is looked up
TAIL = b".,!?:;"
PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class Encoder:
    """Encodes batches of UTF-8 texts to unsigned 16- or 32-bit ids.

    A batch's words are found and numbered in Arrow; Python sees each different word of the batch once.
    Words not in the cache go to the library, plain ones many to a text: only the last token of a run of
    letters is marked as a word end, which tells where each word's ids stop.
    """

    def __init__(self, path: str, generation: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.generation = generation
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, words: list[bytes]) -> None:
        """Put the ids of ``words`` into the cache."""
        new = self.words
        text = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(text) if t.isalpha()]
        chunks = [plain[k : k + 100] for k in range(0, len(plain), 100)]
        rest = [i for i, t in enumerate(text) if not t.isalpha()]
        for chunk, ids in zip(chunks, self._ids([" ".join(text[i] for i in c) for c in chunks]), strict=True):
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.width
            if len(ends) != len(chunk):  # a letter that splits when lower-cased
                rest += chunk
                continue
            data, start = ids.tobytes(), 0
            for i, end in zip(chunk, ends.tolist(), strict=True):
                new[words[i]] = data[start:end]
                start = end
        for i, ids in zip(rest, self._ids([text[i] for i in rest]), strict=True):
            new[words[i]] = ids.tobytes()

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of every one of ``words``."""
        if len(self.words) >= self.generation:
            self.older, self.words = self.words, {}
        new, old = self.words, self.older
        found = list(map(new.get, words))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        missing, split = set(), []
        for i in unknown:
            w = words[i]
            if (ids := old.get(w)) is not None:
                new[w] = ids
                continue
            core = w.rstrip(TAIL)
            if core and len(core) < len(w) and core[-1] in PLAIN:
                split.append((w, core, w[len(core) :]))
                for p in split[-1][1:]:
                    if p not in new:
                        if (ids := old.get(p)) is not None:
                            new[p] = ids
                        else:
                            missing.add(p)
            else:
                missing.add(w)
        self._library(list(missing))
        for w, a, b in split:
            new[w] = new[a] + new[b]
        for i in unknown:
            found[i] = new[words[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, each with the end id, and where each text's ids end.  Null
        counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = words.flatten().dictionary_encode()
        unique = as_list(found.dictionary)
        ids = self._learn(unique) + [np.array([END_ID], self.kind).tobytes()]
        # The end id is one more word, after the words of each text.
        n_words = np.diff(words.offsets.to_numpy())
        stops = np.cumsum(n_words + 1)
        index = np.full(int(stops[-1]) if len(stops) else 0, len(unique), np.int32)
        inner = np.ones(len(index), bool)
        inner[stops - 1] = False
        index[inner] = found.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        begin = (np.cumsum(size) - size).astype(np.int32)
        pool = np.frombuffer(b"".join(ids), self.kind)
        each = size[index]
        upto = np.cumsum(each)
        flat = pool[np.repeat(begin[index] - (upto - each).astype(np.int32), each) + np.arange(int(upto[-1]) if len(upto) else 0, dtype=np.int32)]
        ends = upto[stops - 1] if len(stops) else np.zeros(0, np.int64)
        if len(odd):
            parts = np.split(flat, ends[:-1])
            for i in odd.tolist():
                parts[i] = np.append(self._ids([texts[i].as_py()])[0], np.array(END_ID, self.kind))
            flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return flat, ends.astype(np.int64)


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    claim("tokens", _HELD.clear)
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Encoder(path)
    return _HELD[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file, which every node has."""
    import public_tokenizers

    return public_tokenizers.path(name)
