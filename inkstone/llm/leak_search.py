"""Problem 6: which documents hold the whole query of a test item, or a long stretch of its answer.

Method: Wu-Manber. Queries, and the aligned blocks of answers that every stretch of at least half an answer
must contain, are the patterns; a shift table over blocks of characters skips positions where no pattern
can end, suffix-hash buckets select the patterns that can, direct comparison confirms them, and a block of
an answer is then extended to both sides as far as document and answer agree.

Compared are letters and digits only, after compatibility normalization and case folding.

Defined results: null or empty texts, queries and answers match nothing; a document delivered again, or an
item hit twice, gives one row. Items are searched in blocks of `block` items, one pass over the documents
each, so a test set of any size fits the workers. Extra columns are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame

NEITHER = re.compile(r"[\W_]+")
#: Patterns are searched in groups of similar length, as the shortest of a group bounds the shifts.
LENGTHS = (1, 4, 12, 24)


def skeleton(text: str | None) -> str:
    return NEITHER.sub("", unicodedata.normalize("NFKC", text).casefold()) if text else ""


class WuManber:
    """Search for many strings of at least one character at once."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns = list(dict.fromkeys(patterns))
        self.least = m = min(map(len, self.patterns))
        self.block = b = min(m, 4)
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, list[str]] = {}
        for p in self.patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(p[m - b : m], []).append(p)
        self.far = m - b + 1

    def search(self, text: str) -> Iterator[tuple[int, str]]:
        m, b, far, shift, n = self.least, self.block, self.far, self.shift.get, len(text)
        at = m
        while at <= n:
            key = text[at - b : at]
            if step := shift(key, far):
                at += step
                continue
            for p in self.buckets[key]:
                if text.startswith(p, at - m):
                    yield at - m, p
            at += 1


class LeakIndex:
    """Patterns of some items and what each one means."""

    def __init__(self, items: Iterable[tuple[int, str | None, str | None]]) -> None:
        self.queries: dict[str, list[int]] = {}
        self.blocks: dict[str, list[tuple[int, str, int, int]]] = {}
        for item, query, answer in items:
            if item is None:
                continue
            if q := skeleton(query):
                self.queries.setdefault(q, []).append(item)
            if a := skeleton(answer):
                half = (len(a) + 1) // 2
                size = (half + 1) // 2  # of 2 * size - 1 <= half characters in a row, one aligned block is whole
                for k in range(0, len(a) - size + 1, size):
                    self.blocks.setdefault(a[k : k + size], []).append((item, a, k, half))
        known = {*self.queries, *self.blocks}
        groups = [[p for p in known if lo <= len(p) < hi] for lo, hi in zip(LENGTHS, (*LENGTHS[1:], 1 << 60))]
        self.searches = [WuManber(g) for g in groups if g]

    def leaks(self, text: str | None) -> set[int]:
        found: set[int] = set()
        if not (t := skeleton(text)):
            return found
        for search in self.searches:
            for at, p in search.search(t):
                found.update(self.queries.get(p, ()))
                for item, a, k, half in self.blocks.get(p, ()):
                    if item not in found and _stretch(t, at, a, k, len(p), half):
                        found.add(item)
        return found


def _stretch(t: str, at: int, a: str, k: int, size: int, half: int) -> bool:
    """Do t around at and a around k agree over at least half characters?"""
    left = 0
    while left < k and left < at and a[k - left - 1] == t[at - left - 1]:
        left += 1
    i, j = k + size, at + size
    while i < len(a) and j < len(t) and a[i] == t[j]:
        i, j = i + 1, j + 1
    return left + i - k >= half


def leaked(documents: DataFrame, items: DataFrame, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id) of all documents. items: item_id, query, answer."""
    out = None
    for part in batched((tuple(r) for r in items.select("item_id", "query", "answer").dropDuplicates().orderBy("item_id").toLocalIterator()), block):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            index = LeakIndex(part)
            for batch in batches:
                hits = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in sorted(index.leaks(t))]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], ["doc_id", "item_id"])

        found = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
