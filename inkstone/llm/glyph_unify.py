"""Problem 1: texts that look the same but hold different characters get one consistent form.

Method: look-alike pairs over strings and code points are closed transitively by union-find; of each
class the most frequent member of the corpus represents it; texts are rewritten greedily (leftmost,
longest) by an Aho-Corasick automaton over all other members, until nothing changes.

Defined results: a null text stays null, an empty text stays empty; a text without look-alikes comes
back as it is; ties in frequency go to the member that comes first by (length, code points). Extra
columns pass through; the new column replaces one of the same name.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions.glyphs import HANGUL, look_alike_pairs
from inkstone.llm.batches import slices

CODES = 0x110000
JAMO = re.compile("[ᄀ-ᇿ]")


class UnionFind:
    """Disjoint sets of strings, joined by size with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.size: dict[str, int] = {}

    def find(self, x: str) -> str:
        if x not in self.parent:
            self.parent[x], self.size[x] = x, 1
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]

    def classes(self) -> list[tuple[str, ...]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [tuple(sorted(m, key=lambda s: (len(s), s))) for m in out.values() if len(m) > 1]


def look_alike_classes(pairs: Iterable[tuple[str, str]] | None = None) -> list[tuple[str, ...]]:
    """Transitive classes. A string of several code points is joined with the strings that have look-alikes in their places."""
    sets = UnionFind()
    pairs = list(look_alike_pairs() if pairs is None else pairs)
    for a, b in pairs:
        sets.union(a, b)
    single: dict[str, list[str]] = {}
    for m in sets.classes():
        ones = [c for c in m if len(c) == 1]
        if "" not in m:
            single.update((c, ones) for c in ones)
    for s in {s for pair in pairs for s in pair if len(s) > 1}:
        for other in itertools.product(*(single.get(c, [c]) for c in s)):
            sets.union(s, "".join(other))
        if len(s) > 2:  # a letter with several marks: the letter with the first ones may be one character
            for k in range(2, len(s)):
                if len(head := unicodedata.normalize("NFC", s[:k])) == 1:
                    sets.union(s, head + s[k:])
    return sets.classes()


class Rewriter:
    """The automaton of all members that are not the representative of their class."""

    def __init__(self, classes: list[tuple[str, ...]], counts: dict[str, int]) -> None:
        self.to: dict[str, str] = {}
        for m in classes:
            best = "" if "" in m else max(m, key=lambda s: (counts.get(s, 0), -len(s), [-ord(c) for c in s]))
            self.to.update((s, best) for s in m if s and s != best)
        self.rare: set[int] = set()  # each member has at least one of these code points
        for s in self.to:
            if not any(ord(c) in self.rare for c in s):
                self.rare.add(ord(min(s, key=lambda c: (counts.get(c, 0), -ord(c)))))
        self._build()

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for s, best in self.to.items():  # over UTF-8 bytes: a node then has few children, which the library searches in line
            self.automaton.add_word(key := _bytes(s), (len(key), _bytes(best)))
        if self.to:
            self.automaton.make_automaton()
        self.trigger = np.zeros(CODES, bool)
        self.trigger[sorted(self.rare)] = True
        self.trigger[0x1100:0x1200] = True  # jamo

    def __getstate__(self) -> tuple[dict[str, str], set[int]]:
        return self.to, self.rare  # the tasks build the automaton again, which is cheaper than sending it

    def __setstate__(self, state: tuple[dict[str, str], set[int]]) -> None:
        self.to, self.rare = state
        self._build()

    def once(self, text: str) -> str:
        """text and the result are strings of bytes, as _bytes makes them."""
        out, at = [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            start = end + 1 - n
            out += (text[at:start], best)
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def rewrite(self, text: str) -> str:
        """Until nothing changes; every rewriting leads to a representative, so this ends."""
        old, new = "", _bytes(text := _hangul(text))
        while new != old:
            old, new = new, self.once(new)
        return text if new == _bytes(text) else new.encode("latin-1").decode("utf-8", "surrogatepass")

    def column(self, texts: pa.Array) -> pa.Array:
        if not self.to or not len(texts):
            return texts.cast(pa.string())
        values = texts.to_pylist()
        plain = [v or "" for v in values]
        for a, b in slices(plain):
            codes, starts, sizes = _codes(plain[a:b])
            hits = np.concatenate(([0], np.cumsum(self.trigger[codes])))
            for k in np.nonzero(hits[starts + sizes] > hits[starts])[0]:
                values[a + k] = self.rewrite(values[a + k])
        return pa.array(values, pa.string())


def _bytes(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def _hangul(text: str) -> str:
    """Conjoining jamo as syllables; a rule, so no class holds the 11,172 of them."""
    if JAMO.search(text):
        text = "".join(unicodedata.normalize("NFC", "".join(g)) if h else "".join(g) for h, g in itertools.groupby(text, lambda c: "ᄀ" <= c <= "ᇿ" or HANGUL[0] <= ord(c) <= HANGUL[1]))
    return text


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum(sizes) - sizes, sizes


def member_counts(df: DataFrame, column: str, classes: list[tuple[str, ...]]) -> dict[str, int]:
    """How often each member of a class occurs in all of df[column]; at most one row per member reaches the driver."""
    members = sorted({s for m in classes for s in m if s})
    singles = {ord(s) for s in members if len(s) == 1}
    longer = [(s, ord(min(s, key=lambda c: (ord(c) < 0x300, -ord(c))))) for s in members if len(s) > 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(CODES, np.int64), dict.fromkeys((s for s, _ in longer), 0)
        for batch in batches:
            texts = [v for v in batch.column(0).to_pylist() if v]
            for a, b in slices(texts):
                joined = "\0".join(texts[a:b])
                here = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=CODES)
                total += here
                for s, rare in longer:
                    if here[rare] and all(here[ord(c)] for c in s):
                        many[s] += joined.count(s)
        out = [(chr(c), int(total[c])) for c in np.nonzero(total)[0] if int(c) in singles] + [x for x in many.items() if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["member", "n"])

    found = df.select(column).mapInArrow(count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in found.collect()}


def unify(df: DataFrame, column: str, rewriter: Rewriter, into: str = "unified") -> DataFrame:
    """df with the consistent form of df[column] in a new column."""
    keep = [c for c in df.columns if c != into]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])
    at = keep.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, rewriter.column(batch.column(at))], [*keep, into])

    return df.mapInArrow(run, schema)


def text_items(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """All texts of boxes and table cells as (item_kind, item_id, text)."""
    cell = F.explode("cells").alias("cell")
    return boxes.select(F.lit("box").alias("item_kind"), F.col("box_id").alias("item_id"), "text").unionByName(
        tables.select("table_id", cell).select(F.lit("cell").alias("item_kind"), F.concat("table_id", F.lit("-r"), F.col("cell.row").cast("string"), F.lit("c"), F.col("cell.col").cast("string")).alias("item_id"), F.col("cell.text").alias("text"))
    )


def corpus_rewriter(items: DataFrame, column: str = "text") -> Rewriter:
    classes = look_alike_classes()
    return Rewriter(classes, member_counts(items, column, classes))


def disguised_terms(items: DataFrame, terms: DataFrame, rewriter: Rewriter) -> DataFrame:
    """Items whose whole text, but for blanks at its ends, looks like a term and is made of other characters.

    Null texts and ids give no row; an item delivered twice gives one.
    """
    bare = lambda c: F.trim(c, F.lit(rewriter.rewrite(" ")))  # noqa: E731  all blanks that look alike are this one by now
    looks = unify(terms.where("term is not null").select("term_id", "term"), "term", rewriter, "looks").select("term_id", "term", bare("looks").alias("looks"))
    unified = unify(items.where("text is not null and item_id is not null").select("item_kind", "item_id", "text"), "text", rewriter, "looks").withColumn("looks", bare("looks"))
    return (  # the terms are a fixed list, so they may be broadcast
        unified.join(F.broadcast(looks), "looks").where(F.trim("text") != F.col("term")).select("item_kind", "item_id", "term_id").distinct()
    )
