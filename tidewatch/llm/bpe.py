"""BPE encoding and decoding with a contiguous rank array.

A word is held as its parts between boundaries and, beside it, the rank of every adjacent pair. The smallest rank is
looked for by scanning; its boundary is deleted and the two neighbouring ranks are refreshed, until no pair has a rank.
Scanning a short contiguous array beats any heap, but is quadratic, so longer words use linked parts and a heap.

Null and empty texts give no tokens and decode to the empty string. Repeated rows and further columns pass through.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm._common import schema_with, slices, with_column

#: Words of more symbols than this take the heap.
SHORT_WORD = 96
#: Encoded words that a Python worker remembers; beyond it the memory starts afresh.
REMEMBERED_WORDS = 300_000
#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by the published rule: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge ranks, ids and bytes of a byte-level BPE file."""

    NO_RANK = 1 << 30

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.byte_ids = [vocab[s] for s in symbols]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(of_symbol[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.remembered = _Remembered(self)
        self.pattern = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @functools.cached_property
    def _unassigned(self):
        """Letters and numbers that this regex engine knows but the interpreter's (older) Unicode tables don't: the
        tokenizers library takes them for symbols."""
        known = regex.compile(r"[\p{L}\p{N}]")
        new = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
        runs: list[list[int]] = []
        for c in map(ord, new):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)

    @functools.cached_property
    def _has_unassigned(self):
        return regex.compile(f"[{self._unassigned}]") if self._unassigned else regex.compile(r"(?!)")

    @functools.cached_property
    def _strict_pattern(self):
        u = self._unassigned
        p = PATTERN.replace(r"\p{L}+", rf"[\p{{L}}--[{u}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{u}]]+")
        return regex.compile(p.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{u}])+"), regex.V1)

    def words(self, text: str) -> list[str]:
        plain = text.isascii() or not self._has_unassigned.search(text)
        return (self.pattern if plain else self._strict_pattern).findall(text)

    def encode(self, text: str, out: array, special: bool = True) -> None:
        """Appends the ids of a text; without special, the names of special tokens are plain text."""
        known = self.remembered
        for piece in self.at_special.split(text) if special and self.at_special else [text]:
            if special and piece in self.special:
                out.append(self.special[piece])
            elif piece:
                for ids in map(known.__getitem__, self.words(piece)):
                    out += ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Remembered(dict):
    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> array:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        parts = [self.vocab.byte_ids[b] for b in word.encode()]
        merge = merge_short if len(parts) <= SHORT_WORD else merge_long
        out = array("i", merge(parts, self.vocab))
        if len(word) <= SHORT_WORD:
            self[word] = out
        return out


def merge_short(parts: list[int], vocab: Vocabulary) -> list[int]:
    """parts: a symbol between each two boundaries; ranks[i]: that of the pair around boundary i."""
    rank, merged, none = vocab.rank.get, vocab.merged, vocab.NO_RANK
    ranks = [rank(p, none) for p in zip(parts, parts[1:])]
    while ranks and (least := min(ranks)) != none:
        i = ranks.index(least)
        parts[i] = merged[least]
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank((parts[i], parts[i + 1]), none)
        if i:
            ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
    return parts


def merge_long(parts: list[int], vocab: Vocabulary) -> list[int]:
    """The same merges in the same order for a long word: linked parts, and a heap of (rank, place)."""
    rank, n = vocab.rank.get, len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or rank((parts[i], parts[j])) != r:
            continue
        parts[i], parts[j] = vocab.merged[r], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (x := rank((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := rank((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (x, h))
    return [p for p in parts if p is not None]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """Adds the token ids of every whole text and, if named, what they decode to, in one pass of one Python worker. A
    column that already has one of these names is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in slices(batches):
            flat, ends = array("i"), [0]
            for text in batch.column(text_col).to_pylist():
                vocab.encode(text or "", flat)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            batch = with_column(batch, ids_col, ids)
            if decoded_col:
                said = [vocab.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                batch = with_column(batch, decoded_col, pa.array(said, pa.string()))
            yield batch

    schema = schema_with(df, ids_col, T.ArrayType(T.IntegerType(), False))
    if decoded_col:
        schema = T.StructType([*(f for f in schema if f.name != decoded_col), T.StructField(decoded_col, T.StringType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for, special tokens included. Ids unknown to the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in slices(batches):
            column = batch.column(ids_col)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [vocab.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield with_column(batch, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema_with(df, text_col, T.StringType()))
