"""Encoding of texts by a byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. A word's bytes are folded: in every step the neighbouring pieces
whose joined bytes have the lowest rank are merged, the leftmost first, until no joined bytes have a rank; the ranks of
what is left are the ids. The merges wait in a heap, so that a word takes n log n steps of its length. Every task encodes
its texts in one pass over Arrow batches and remembers the words that it has folded. Decoding concatenates the binary
pieces in native expressions.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column

# White space by Unicode, inside a character class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BASIC, _ALL = 0xFFFF, 0x10FFFF
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _class_of(kind: str, last: int) -> str:
    """The characters up to ``last`` of a general category of Unicode, inside a character class."""
    runs: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@cache
def _pattern(last: int) -> re.Pattern:
    """The cut of a text into words, for texts of characters up to ``last``: the classes of the basic plane are tables, the
    others are lists of runs, which take longer."""
    letter, digit = _class_of("L", last), _class_of("N", last)
    return re.compile(rf" ?[{letter}]++|'(?:s|t|re|ve|m|ll|d)| ?[{digit}]++| ?[^{_SPACE}{letter}{digit}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def words(text: str) -> list[str]:
    """The words of a text."""
    return _pattern(_ALL if not text.isascii() and _BEYOND.search(text) else _BASIC).findall(text)


def folded(ranks: dict[bytes, int], raw: bytes) -> list[int]:
    """Ids of some bytes by ranked merges."""
    n = len(raw)
    # The end of the piece that begins at a place, 0 where none does, and the beginning of the piece before it.
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, end = heappop(waiting)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two pieces has been merged with another
        ends[i], ends[middle] = end, 0
        if i and (r := ranks.get(raw[before[i] : end])) is not None:
            heappush(waiting, (r, before[i], end))
        if end < n:
            before[end] = i
            if (r := ranks.get(raw[i : ends[end]])) is not None:
                heappush(waiting, (r, i, ends[end]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[raw[i : ends[i]]])
        i = ends[i]
    return ids


class _Words(dict):
    """Ids by word; up to ``most`` words of usual length are remembered, others are folded each time."""

    LONG = 64

    def __init__(self, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        rank = self.ranks.get(raw)
        ids = tuple(folded(self.ranks, raw)) if rank is None else (rank,)
        if len(self) < self.most and len(raw) <= self.LONG:
            self[word] = ids
        return ids


class ByteBpe:
    """Columns that encode and decode by one vocabulary."""

    #: Ids that a task hands on at once.
    PART = 1 << 22

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encode(self, documents: DataFrame, doc: str, text: str, most: int = 65_536) -> DataFrame:
        """(doc_id, ids): one row for each row; the list is empty for a null or empty text. Texts of any length are
        encoded whole; strings that look like special tokens are plain text; other columns are not read. A task remembers
        up to ``most`` words."""
        ranks, part = self.ranks, self.PART
        read = documents.select(column(doc).alias("doc_id"), F.make_valid_utf8(column(text)).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_of = _Words(ranks, most).__getitem__
            for batch in batches:
                docs, start, ids, ends = batch.column(0), 0, array("i"), array("i", [0])
                for at, cell in enumerate(batch.column(1), 1):
                    if content := cell.as_py():
                        ids.extend(chain.from_iterable(map(ids_of, words(content))))
                    ends.append(len(ids))
                    if len(ids) >= part or at == len(docs):
                        lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
                        yield pa.RecordBatch.from_arrays([docs.slice(start, at - start), lists], ["doc_id", "ids"])
                        start, ids, ends = at, array("i"), array("i", [0])

        return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, ids array<int>")

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: its pieces' bytes, one after the other."""
        listed = [base64.b64encode(k).decode() for k, _ in sorted(self.ranks.items(), key=lambda e: e[1])]
        pieces = F.from_json(F.lit(json.dumps(listed)), "array<binary>")
        return _with(pieces, lambda t: F.aggregate(ids, F.lit(b""), lambda s, i: F.concat(s, F.get(t, i)))).cast("string")
