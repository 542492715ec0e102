"""Byte-pair encoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens.  It starts
with one state that loops on every symbol.  Merge (a, b) -> c adds one gadget:
the state that a leads to is copied without its b arc, a leads to the copy, and
c leads from wherever a does to where b led.  After all merges the automaton
accepts exactly the token sequences that greedy merging yields, one for each
word.  Where a token leads doesn't depend on where it starts, so the finished
automaton is a state for each token and a table with a bit for each state and
token: whether the arc is there.

The gadget of (a, b) takes the arc b from the copies that are made of a's state
later on, and takes with it the arcs of the tokens that begin with b by later
merges.  With tokens numbered in preorder of their right parts (for states) and
of their left parts (for arcs), later merges first, both are ranges of numbers:
a gadget clears one rectangle of the table.  Numbers that no gadget tells apart
share a row or a column.

A word is encoded from left to right.  Every beginning of a word has one walk,
so at each position one token ends that has an arc from where the walk of what
is before it leads.  From each position on, the tokens that begin there are
looked up in the table, and nothing is taken back.
Decoding emits the labels of the arcs, joined as the tokenizer file's decoder says.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import KEPT, documents, give_back, small_batches, text_of
from tidelog.llm.token_table import TokenTable

VOCABULARY = "word_bpe_49k.json"

#: Rows of the transition table that are made at once.
ROWS_MADE = 1000

#: Texts of a batch that are encoded and decoded at once: their chunks take many times their own bytes.
TEXTS_AT_ONCE = 500

#: Texts of these characters are normalised here; others by the tokenizer file's own normaliser.
PLAIN = regex.compile(r"[\x09-\x0d\x20-\x7e\xa0-ɏ‐-‧‰-⁞₠-₿]*")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The automaton of a merge list.

    states[token] is the state that a token leads to and columns[token] its
    column; rows[state] are the bits of the lost arcs, eight columns a byte.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>"):
        n = max(vocab.values()) + 1
        self.left, self.right, self.born, self.reached = [-1] * n, [-1] * n, [0] * n, [True] * n
        self.suffix = suffix
        letters = byte_letters()
        #: Words are spelled in letters: a byte's letter is chr(byte), the last byte's chr(256 + byte).
        self.tokens: dict[str, int] = {}
        for token, k in vocab.items():
            ends = token.endswith(suffix)
            raw = [letters[c] for c in (token.removesuffix(suffix) if ends else token)]
            if ends:
                raw[-1] += 256
            self.tokens["".join(map(chr, raw))] = k
        #: lost[a << 20 | b] is the merge whose gadget took the arc b from the state that a leads to.
        self.lost: dict[int, int] = {}
        for when, (a, b) in enumerate(merges, 1):
            self._gadget(vocab[a], vocab[b], vocab[a + b], when)
        self._finish()
        self.tokens = {spelled: k for spelled, k in self.tokens.items() if self.reached[k]}
        for spelled in list(self.tokens):
            for i in range(1, len(spelled)):  # beginnings of tokens that are none
                self.tokens.setdefault(spelled[:i], -1)

    def _gadget(self, a: int, b: int, c: int, when: int) -> None:
        self.left[c], self.right[c], self.born[c] = a, b, when
        self.reached[c] = self._arc(a, b)
        if self.reached[c]:
            self.lost[a << 20 | b] = when

    def _arc(self, before: int, token: int) -> bool:
        """Whether the state that `before` leads to has an arc for the token, while the automaton is made.

        A token led where its right part led before its merge, and had the arcs
        that its left part had just after.
        """
        born, lost, limit = self.born, self.lost, 1 << 60
        if not (self.reached[before] and self.reached[token]):
            return False
        while True:
            if lost.get(before << 20 | token, limit) < limit:
                return False
            if born[before] > born[token]:
                limit, before = min(limit, born[before]), self.right[before]
            elif born[token]:
                limit, token = min(limit, born[token] + 1), self.left[token]
            else:
                return True

    def _numbered(self, part: list[int]) -> tuple[list[list[int]], list[int], list[int]]:
        """For each token the tokens made of it as that part, later merges first, and the range of numbers below it."""
        made: list[list[int]] = [[] for _ in part]
        for token in sorted(range(len(part)), key=lambda k: -self.born[k]):
            if part[token] >= 0:
                made[part[token]].append(token)
        first, end, number = [0] * len(part), [0] * len(part), 0
        stack = [(token, False) for token in range(len(part)) if part[token] < 0]
        while stack:
            token, done = stack.pop()
            if done:
                end[token] = number
                continue
            first[token], number = number, number + 1
            stack.append((token, True))
            stack.extend((t, False) for t in reversed(made[token]))
        return made, first, end

    def _finish(self) -> None:
        """The table: a gadget clears the states of tokens that end in a, and the arcs of those that begin with b, where merged later."""
        (of_a, row, row_end), (of_b, column, column_end) = self._numbered(self.right), self._numbered(self.left)
        born = self.born
        cleared = []
        for pair, when in self.lost.items():
            a, b = pair >> 20, pair & 0xFFFFF
            # leftmost first: a token made of a by this very merge has it no more, one made of b still has
            later_a = bisect_left(of_a[a], -when, key=lambda t: -born[t])
            later_b = bisect_right(of_b[b], -when, key=lambda t: -born[t])
            cleared.append((row[a], row_end[of_a[a][later_a - 1]] if later_a else row[a] + 1, column[b], column_end[of_b[b][later_b - 1]] if later_b else column[b] + 1))
        cuts = np.array(cleared, np.int64).reshape(-1, 4)
        row_cuts, column_cuts = (np.unique(np.append(cuts[:, k : k + 2], 0)) for k in (0, 2))
        self.states = (np.searchsorted(row_cuts, row, "right") - 1).tolist()
        self.columns = (np.searchsorted(column_cuts, column, "right") - 1).tolist()
        ends = np.column_stack([np.searchsorted(row_cuts if k < 2 else column_cuts, cuts[:, k]) for k in range(4)])
        self.rows: list[bytes] = []
        for k in range(0, len(row_cuts), ROWS_MADE):  # bounds memory
            part = np.zeros((min(ROWS_MADE, len(row_cuts) - k), len(column_cuts)), bool)
            for r0, r1, c0, c1 in ends[(ends[:, 0] < k + ROWS_MADE) & (ends[:, 1] > k)].tolist():
                part[max(r0 - k, 0) : r1 - k, c0:c1] = True
            self.rows += [x.tobytes() for x in np.packbits(part, axis=1, bitorder="little")]

    def step(self, state: int, token: int) -> int:
        """The state that an arc leads to, or -1 without the arc; -1 as state is where walks begin."""
        column = self.columns[token]
        if not self.reached[token] or state >= 0 and self.rows[state][column >> 3] >> (column & 7) & 1:
            return -1
        return self.states[token]

    def walk(self, word: bytes) -> list[int]:
        """The tokens of a word: the arcs of the one walk that spells it."""
        n, tokens, rows, states, columns = len(word), self.tokens, self.rows, self.states, self.columns
        spelled = word.decode("latin-1")
        spelled = spelled[:-1] + chr(256 + word[-1])
        whole = tokens.get(spelled, -1)
        if whole >= 0:
            return [whole]
        last = [-1] * (n + 1)  # of the walk to each position the last token
        begin = [0] * (n + 1)  # and where that begins
        for j in range(n):
            if j and last[j] < 0:
                continue
            row = rows[states[last[j]]] if j else None
            for i in range(j + 1, n + 1):
                token = tokens.get(spelled[j:i])
                if token is None:
                    break
                if token >= 0:
                    column = columns[token]
                    if row is None or not row[column >> 3] >> (column & 7) & 1:
                        last[i], begin[i] = token, j
        if last[n] < 0:
            raise ValueError(f"no walk spells {word!r}")
        path, i = [], n
        while i:
            path.append(last[i])
            i = begin[i]
        return path[::-1]


class Codec:
    """Encoding and decoding as a tokenizer file says: special strings, normaliser, words, automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        labels = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.labels = np.array([labels.get(k, "") for k in range(max(labels) + 1)], dtype=object)
        self.table = TokenTable(self._encode_chunks)
        self._slow = None

    def _library(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def split(self, text: str) -> list[str]:
        """The pre-split words of a text without special strings."""
        if PLAIN.fullmatch(text):
            return WORD.findall(unicodedata.normalize("NFC", text).lower())
        own = self._library()
        letters = byte_letters()
        pieces = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
        return [bytes(letters[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def _plain(self, text: str) -> list[int]:
        return [k for w in self.split(text) for k in self.automaton.walk(w.encode("utf-8", "surrogateescape"))]

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        if not self.special or "<|" not in text:
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(self.at_special.split(text)):
            out += [self.special[part]] if k % 2 else self._plain(part)
        return out

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode(c) for c in chunks]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((k for x in found for k in x), np.int32)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin and end."""
        return self.table.ids(texts)

    def decode(self, ids) -> str:
        return " ".join(self.labels[ids])


_CODECS: dict[str, Codec] = {}
KEPT.append(_CODECS)


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, compiled once in a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def texts(own: Codec, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The labels of ids that stand in a row, joined for each text."""
    labels = own.labels[flat]
    return pa.array([" ".join(labels[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())


def encode(text: Column, path: str) -> Column:
    """Token ids of a text: array<int>, empty for a null or empty text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for b in batches:
            yield lists(*own.encode_many(b))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids, special tokens included; empty for no ids or null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for b in batches:
            yield texts(own, b.values.to_numpy(zero_copy_only=False), b.offsets.to_numpy())

    return F.arrow_udf(run, "string")(ids)


def encode_and_decode(text: Column, path: str) -> Column:
    """Both in one pass of Python: struct<ids, decoded>, decoded from the ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for b in batches:
            for k in range(0, max(1, len(b)), TEXTS_AT_ONCE):
                flat, ends = own.encode_many(b[k : k + TEXTS_AT_ONCE])
                yield pa.StructArray.from_arrays([lists(flat, ends), texts(own, flat, ends)], ["ids", "decoded"])
            del b, flat, ends
            give_back()  # between batches a worker holds its tables only

    return F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")(text)


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (array<int>) and decoded (string) of text.

    One output row for each row, with its other columns; own columns named ids
    or decoded are replaced.  A null or empty text has no ids and decodes to the
    empty string.  No shuffle; memory is bounded by a batch of rows.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    both = docs.drop("ids", "decoded").withColumn("both_", encode_and_decode(text_of(), path))
    return both.withColumns({"ids": F.col("both_.ids"), "decoded": F.col("both_.decoded")}).drop("both_")


def digests() -> list[Column]:
    """ids_sha256 and decoded_sha256 of columns ids and decoded."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return [F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op2_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    done = tokenize(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests())
