"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 8).

The merges are not replayed. All vocabulary entries go into one Aho-Corasick automaton whose alphabet is
the 256 bytes, mapped to Latin-1 characters. Over a piece of text it gives the longest entry at every
position; the encoder walks from the left, takes the longest entry that fits behind the last token, falls
back to the next shorter entry and, where none fits, drops the last token and forbids the position it ended
at. "Fits" is a memoised question about two tokens: whether merging by rank would ever have joined something
across their border. Every position is forbidden at most once, so the time is linear in the text, and the
tokens are exactly those of the merges.

Pieces recur, so the ids of a piece, and of the blank-delimited chunk around it, are kept in bounded memos
of the Python worker; the bounds only cost time, never change a result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie unless a caller says otherwise.
TOKENIZERS = os.environ.get("WEFTWORK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the public pattern that cuts text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode White_Space; Python's own \s also has U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BEFORE_BLANK_ASCII = tuple(f"{c} " for c in "\t\n\v\f\r ")
BEFORE_BLANK_OTHER = re.compile(f"[{SPACE}] ").search
MEMO_ENTRIES = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Memo(dict):
    """Ids by text, worked out where missing; emptied when full, and long texts are not kept."""

    def __init__(self, work, entries: int):
        self.work, self.entries = work, entries

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.work(text)
        if len(text) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[text] = ids
        return ids


class ByteBPE:
    """The vocabulary, its automaton and the memos; one per Python worker and file."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        latin = {word: "".join(chr(letters[c]) for c in word) for word in model["vocab"]}
        self.ids = {latin[word]: i for word, i in model["vocab"].items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for left, right in model["merges"]:
            pair = (self.ids[latin[left]], self.ids[latin[right]])
            whole = self.ids[latin[left] + latin[right]]
            self.merged[pair] = whole
            self.parts.setdefault(whole, pair)
        self.length = {i: len(s) for s, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        # the longest proper prefix of an entry that is an entry itself
        self.shorter: dict[int, int] = {}
        for s, i in self.ids.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := self.ids.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES).findall
        self.runs = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.piece_memo = _Memo(self.encode_piece, memo_entries)
        self.run_memo = _Memo(self.encode_run, memo_entries)
        #: by what stands behind a blank
        self.word_memo = _Memo(lambda word: self.encode_run(" " + word), memo_entries)
        self.memo_entries = memo_entries

    def compatible(self, left: int, right: int) -> bool:
        """Would merging by rank leave a border between ``left`` and ``right``? Both are taken apart again,
        the younger one first; a merge across the border that is older than what is still whole says no."""
        limit = 1 << 40
        a, b = left, right
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            take_left = a > b
            while True:
                if take_left:
                    limit = a
                    if a in self.parts:
                        a = self.parts[a][1]
                        break
                    # a single byte: only the right side can still be taken apart
                    if b not in self.parts:
                        return True
                    take_left = False
                else:
                    limit = b + 1
                    if b in self.parts:
                        b = self.parts[b][0]
                        break
                    if a not in self.parts:
                        return True
                    take_left = True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return (whole,)
        n = len(s)
        longest = [-1] * n
        for end, i in self.automaton.iter(s):
            longest[end - self.length[i] + 1] = i  # ends only grow: the last is the longest
        open_at = bytearray(b"\x01") * (n + 1)
        fits, length, shorter = self.fits, self.length, self.shorter
        out: list[int] = []
        pos, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = pos + length[token]
                if open_at[end]:
                    if last < 0:
                        good = True
                    else:
                        good = fits.get((last, token))
                        if good is None:
                            if len(fits) > 4 * self.memo_entries:
                                fits.clear()
                            good = fits[(last, token)] = self.compatible(last, token)
                    if good:
                        out.append(token)
                        pos = end
                        if pos == n:
                            return tuple(out)
                        token = longest[pos]
                        break
                token = shorter.get(token, -1)
                if token < 0:
                    open_at[pos] = 0
                    token = out.pop()
                    pos -= length[token]
                    break

    def encode_run(self, run: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece_memo.__getitem__, self.pieces(run))))

    def parts_of(self, text: str) -> list[tuple[int, ...]]:
        """The ids of the text, part by part. No piece reaches from a character that is no blank over to a
        blank, so the text may be cut there; cutting at every U+0020 does just that unless a blank stands
        before one, and then the text is cut by runs."""
        if any(map(text.__contains__, BEFORE_BLANK_ASCII)) or (not text.isascii() and BEFORE_BLANK_OTHER(text)):
            return list(map(self.run_memo.__getitem__, self.runs(text)))
        words = text.split(" ")
        head = words.pop(0)
        return [self.run_memo[head], *map(self.word_memo.__getitem__, words)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts_of(text)))


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def _texts(column: pa.Array) -> Iterator[str | None]:
    for raw in column:
        value = raw.as_py()
        yield value if value is None else value.decode("utf-8", "replace")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row: whole texts, no special tokens. A null text and an
    empty text both have the empty list; other columns are not carried along; repeated rows come out
    repeated; bytes that are no UTF-8 count as U+FFFD."""
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            parts: list[tuple[int, ...]] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int64)
            for i, text in enumerate(_texts(batch.column(1))):
                mine = bpe.parts_of(text) if text else []
                parts += mine
                ends[i + 1] = ends[i] + sum(map(len, mine))
            flat = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return _in_batches(docs, id_col, text_col).mapInArrow(encode, schema)


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text (null and empty: 0)."""
    path = path or vocabulary_path()
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            sizes = [sum(map(len, bpe.parts_of(text))) if text else 0 for text in _texts(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("binary").alias("_text")).mapInArrow(count, schema)


def _in_batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # bytes, not text: a string that is no UTF-8 must not end the job
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
