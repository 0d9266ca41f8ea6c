"""Evaluation texts leaking into training text: a BM25 inverted index of the test items, searched by block-max WAND.

Training texts are cut at the words that no item holds, which can be in no common run; what is left in stretches of at
least ``run`` words is queried passage by passage (overlapping windows of twice the run). An item's threshold is the least BM25 score that any run of
``run`` consecutive words of the item reaches against the item itself, so every passage that holds such a run scores at
least that much and none is missed. Retrieved pairs are verified word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters or digits, in lower case."""
    return _WORD.findall(text.lower())


class ItemIndex:
    """Postings of the items' words with BM25 impacts, cut into blocks that know their largest impact."""

    K1, B, BLOCK = 1.2, 0.75, 32

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in items if t) if len(w) >= run]
        self.item_ids = [i for i, _ in kept]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
        self.sequences = [[self.vocabulary[w] for w in ws] for _, ws in kept]
        n, mean = len(kept), (sum(len(s) for s in self.sequences) / len(kept) if kept else 0.0)
        df = Counter(t for s in self.sequences for t in set(s))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        impacts: list[dict[int, float]] = []
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for item, s in enumerate(self.sequences):
            norm = self.K1 * (1 - self.B + self.B * len(s) / mean)
            own = {t: idf[t] * tf * (self.K1 + 1) / (tf + norm) for t, tf in Counter(s).items()}
            impacts.append(own)
            for t, w in own.items():
                self.postings[t].append((item, w))
        self.largest = np.array([max((w for _, w in p), default=0.0) for p in self.postings] + [0.0])
        slack = 1e-9
        self.threshold = [
            min(sum(own[t] for t in set(s[k : k + run])) for k in range(len(s) - run + 1)) - slack for own, s in zip(impacts, self.sequences, strict=True)
        ]
        self.least = min(self.threshold, default=math.inf)
        # (last item, largest impact, least threshold) of every block of postings.
        self.blocks = [
            [(part[-1][0], max(w for _, w in part), min(self.threshold[i] for i, _ in part)) for part in (p[k : k + self.BLOCK] for k in range(0, len(p), self.BLOCK))] for p in self.postings
        ]
        self.runs = [{tuple(s[k : k + run]) for k in range(len(s) - run + 1)} for s in self.sequences]

    def search(self, terms: list[int]) -> list[int]:
        """Items whose BM25 score for the distinct terms reaches their threshold: document-at-a-time block-max WAND."""
        lists = [self.postings[t] for t in terms]
        at = [0] * len(terms)
        found = []
        while True:
            live = sorted((k for k in range(len(terms)) if at[k] < len(lists[k])), key=lambda k: lists[k][at[k]][0])
            bound, pivot = 0.0, None
            for rank, k in enumerate(live):
                bound += self.largest[terms[k]]
                if bound >= self.least:
                    pivot = rank
                    break
            if pivot is None:
                return found
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block_bound, block_end, needed = 0.0, math.inf, math.inf
            for k in live[: pivot + 1]:
                b = at[k] // self.BLOCK
                ends = self.blocks[terms[k]]
                while b < len(ends) and ends[b][0] < item:
                    b += 1
                if b < len(ends):
                    block_bound += ends[b][1]
                    block_end = min(block_end, ends[b][0])
                    needed = min(needed, ends[b][2])
            if block_bound < needed:
                # No item up to the end of these blocks can reach its threshold.
                beyond = lists[live[pivot + 1]][at[live[pivot + 1]]][0] if pivot + 1 < len(live) else math.inf
                target = min(block_end + 1, beyond)
                for k in live[: pivot + 1]:
                    at[k] = self._skip(lists[k], at[k], target)
            elif lists[live[0]][at[live[0]]][0] == item:
                score = 0.0
                for k in live[: pivot + 1]:
                    score += lists[k][at[k]][1]
                    at[k] += 1
                if score >= self.threshold[item]:
                    found.append(item)
            else:
                for k in live[:pivot]:
                    at[k] = self._skip(lists[k], at[k], item)

    @staticmethod
    def _skip(postings: list[tuple[int, float]], at: int, item: float) -> int:
        while at < len(postings) and postings[at][0] < item:
            at += 1
        return at

    def leaks(self, text: str) -> list[int]:
        """Ids of the items of which the text holds ``run`` consecutive words."""
        words = words_of(text)
        if len(words) < self.run or not self.item_ids:
            return []
        terms = list(map(self.vocabulary.get, words, repeat(-1)))
        ids = np.array(terms)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        hits: set[int] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for k in range(start, end - self.run + 1, self.run):
                passage = terms[k : min(k + 2 * self.run, end)]
                query = list(set(passage))
                if self.largest[query].sum() < self.least:
                    continue
                for item in self.search(query):
                    if item not in hits and any(tuple(passage[s : s + self.run]) in self.runs[item] for s in range(len(passage) - self.run + 1)):
                        hits.add(item)
        return [self.item_ids[i] for i in sorted(hits)]


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id): the documents that hold at least ``run`` consecutive words of an item, each pair once.

    The items are the query set: they are indexed in blocks of at most ``block`` items, each a bounded object sent to the
    tasks, and each block's index meets every document in one narrow pass. Null, empty and short texts on either side
    are in no pair. Repeated items are pairs of their own; other columns are not read.
    """
    listed = items.select(column(item).cast("bigint").alias("item_id"), column(item_text).alias("text")).filter(F.col("text").isNotNull())
    count = listed.count()
    parts = max(1, -(-count // block))
    source = documents.select(column(doc).cast("bigint").alias("doc_id"), column(text).alias("text"))
    found = []
    for part in range(parts):
        rows = listed if parts == 1 else listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        found.append(_search(source, ItemIndex([(r["item_id"], r["text"]) for r in rows.collect()], run)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _search(source: DataFrame, index: ItemIndex) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hits = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    for hit in index.leaks(text):
                        docs.append(doc)
                        hits.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return source.mapInArrow(run, "doc_id bigint, item_id bigint")
