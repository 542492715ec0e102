"""Token ids of many words by table: each distinct word is encoded once, runs of words by array steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words kept in a process.  A fuller table drops the words met least often; that changes no result.
WORDS_KEPT = 300_000

#: A mark after a letter, at the end of a chunk.
MARKED = r"([a-z])([.,;:!?])([\x20\x09-\x0D]|$)"


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks between white space of all texts (null: none), and where each text's begin and end.

    For tokenizers that lower-case, drop white space and part letters from
    marks: A-Z is lower-cased and a mark that ends a chunk after a letter stands
    apart, so that fewer chunks are distinct; the tokens are the same.  Texts
    with ``<|``, which may hold special strings, aren't changed.
    """
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), MARKED, r"\1 \2\3")
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy()
    return lists.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


class _Rows(dict):
    def __init__(self):
        self.new: list = []

    def __missing__(self, word):
        row = self[word] = len(self)
        self.new.append(word)
        return row


class TokenTable:
    """encode_many: from a list of chunks to the sizes of their id lists and all ids in a row."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = WORDS_KEPT):
        self.encode_many, self.kept = encode_many, kept
        self.rows = _Rows()
        self.met = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows in a row, and the ends of each."""
        size = self.sizes[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[row] - ends[:-1], size)], ends

    def _thin(self) -> None:
        """Keep the words met more often than half of them."""
        keep = np.flatnonzero(self.met > max(1, np.median(self.met)))
        self.flat, ends = self._gather(keep)
        self.sizes, self.met, self.starts = self.sizes[keep], self.met[keep] // 2, ends[:-1]
        words = list(self.rows)
        self.rows = _Rows()
        self.rows.update((words[k], i) for i, k in enumerate(keep.tolist()))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts: all of them in a row, and where each text's ids begin and end."""
        if len(self.rows) > self.kept:
            self._thin()
        chunks, ends = chunks_of(texts)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        row = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
        if self.rows.new:
            sizes, flat = self.encode_many(self.rows.new)
            self.rows.new = []
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.met = np.concatenate([self.met, np.zeros(len(sizes), np.int64)])
        self.met[row] += 1
        ids, cuts = self._gather(row[coded.indices.to_numpy()])
        return ids, cuts[ends]
