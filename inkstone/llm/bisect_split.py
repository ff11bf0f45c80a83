"""Problem 4: items over a size limit are cut into pieces within it, at natural boundaries where there are any.

Method: recursive bisection. A span longer than the limit minus the overlap is cut at the strongest
natural boundary near its midpoint (the middle half of the span; else the natural boundary nearest to
the midpoint; else, a forced cut, at a line break, a clause end, a blank or the midpoint itself), and so
are its halves; then each piece but the first gets the overlap in front. The first piece has no overlap, so the
first `overlap` characters of a text are not divided: every cut lies beyond them, and all overlaps are whole.

Natural boundaries: the text's start and end, blank lines, and sentence ends with the closing quotes and
brackets after them; if row ends are given (tables), these alone.

Defined results: items with a null or empty text, a null id, or no limit for their kind give no rows, and
so do items within their limit. An item delivered again counts once (the latest by `at`). Extra columns
are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators.chunking import latest

CLOSERS = "\"'”’）)】]》〉」』〕｝}»"
_C = f"[{re.escape(CLOSERS)}]*"
NATURAL = re.compile(rf"(\n\s*\n)|[。！？]{_C}|[.!?]{_C}(?=\s|\Z)")
WEAK = (re.compile(r"\n"), re.compile(r"[，、；：,;:]"), re.compile(r"\s"))
MARK = re.compile(r"[̀-ͯ‍︀-️]")
OUT = "item_kind string, item_id string, cut string, piece int, pieces int, start int, end int, text string"


def natural_boundaries(text: str, row_ends: list[int] | None = None) -> dict[int, int]:
    """Position -> strength (2 blank line or row end, 1 sentence end), the text's start and end included."""
    out = {0: 2, len(text): 2}
    if row_ends is not None:
        return out | {e: 2 for e in row_ends if 0 < e < len(text)}
    for m in NATURAL.finditer(text):
        if m.group(1):
            out[m.start()] = out[m.end()] = 2
        else:
            out.setdefault(m.end(), 1)
    return out


def longest_stretch(boundaries: dict[int, int]) -> int:
    at = sorted(boundaries)
    return max((b - a for a, b in zip(at, at[1:])), default=0)


def cut_positions(text: str, limit: int, overlap: int, boundaries: dict[int, int]) -> list[int]:
    """The text's start, the cuts and its end; from `overlap` on, no part has more than limit - overlap characters."""
    room = max(1, limit - overlap)
    strong = sorted(p for p, s in boundaries.items() if s == 2 and overlap < p < len(text))
    every = sorted(p for p in boundaries if overlap < p < len(text))
    weak: dict[int, list[int]] = {}

    def nearest(at: list[int], a: int, b: int, middle: float) -> int | None:
        lo, hi = bisect_right(at, a), bisect_left(at, b)
        if lo >= hi:
            return None
        k = bisect_left(at, middle, lo, hi)
        return min(at[max(lo, k - 1) : min(hi, k + 1)], key=lambda p: (abs(p - middle), p))

    def choose(a: int, b: int) -> int:
        middle, quarter = (a + b) / 2, (b - a) / 4
        for at in (strong, every):
            if (p := nearest(at, a + quarter, b - quarter, middle)) is not None:
                return p
        if (p := nearest(every, a, b, middle)) is not None:
            return p
        for k, pattern in enumerate(WEAK):
            if k not in weak:
                weak[k] = [m.end() for m in pattern.finditer(text) if m.end() > overlap]
            if (p := nearest(weak[k], a + quarter, b - quarter, middle)) is not None:
                return p
        p = int(middle)
        while p > a + 1 and MARK.match(text, p):  # keep a mark with its letter
            p -= 1
        return p if not MARK.match(text, p) else int(middle)

    out, spans = [], [(overlap, len(text))]
    while spans:
        a, b = spans.pop()
        if b - a <= room or b - a < 2:
            out.append(b)
        else:
            p = choose(a, b)
            spans += [(p, b), (a, p)]
    return [0, *sorted(out)]


def split_text(text: str, limit: int, overlap: int, row_ends: list[int] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The kind of cut and the pieces as (start, end); a text within the limit is one piece."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap in [0, limit)")
    boundaries = natural_boundaries(text, row_ends)
    cut = "forced" if longest_stretch(boundaries) > limit else "boundary"
    if len(text) <= limit:
        return cut, [(0, len(text))]
    at = cut_positions(text, limit, overlap, boundaries)
    return cut, [(max(0, a - overlap), b) for a, b in zip(at, at[1:])]


def items(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Sections, pages and tables as (item_kind, item_id, text, row_ends, at)."""
    none = F.lit(None).cast("array<int>")
    page = pages.select(F.lit("page").alias("item_kind"), F.concat("doc_id", F.lit("-p"), F.lpad(F.col("page").cast("string"), F.greatest(F.lit(3), F.length(F.col("page").cast("string"))), F.lit("0"))).alias("item_id"), "text", none.alias("row_ends"), F.col("parsed_at").alias("at"))
    section = pages.select(F.explode("sections").alias("s"), "parsed_at").select(F.lit("section").alias("item_kind"), F.col("s.section_id").alias("item_id"), F.col("s.text").alias("text"), none.alias("row_ends"), F.col("parsed_at").alias("at"))
    rows = F.filter(F.transform("protected_rows", lambda r: r.text), lambda t: t.isNotNull())
    ends = F.aggregate("texts", F.array().cast("array<int>"), lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)) + F.length(t))))
    table = (
        tables.select("table_id", "parsed_at", rows.alias("texts")).withColumn("text", F.array_join("texts", "\n"))
        .select(F.lit("table").alias("item_kind"), F.col("table_id").alias("item_id"), "text", F.when(F.size("texts") > 0, ends).alias("row_ends"), F.col("parsed_at").alias("at"))
    )
    return section.unionByName(page).unionByName(table)


def split_items(things: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of all oversized items. limits (item_kind, max_chars, overlap_chars) has a row per kind, so it is broadcast."""
    bounds = limits.where("max_chars is not null").select("item_kind", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    over = things.select("item_kind", "item_id", "text", "row_ends", "at").join(F.broadcast(bounds), "item_kind").where((F.length("text") > F.col("max_chars")) & F.col("item_id").isNotNull())
    over = latest(over, ["item_kind", "item_id"], ["at", "text"]).select("item_kind", "item_id", "text", "row_ends", "max_chars", "overlap_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kind, item, text, ends, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                cut, pieces = split_text(text, limit, overlap, ends)
                out += ((kind, item, cut, k, len(pieces), a, b, text[a:b] if with_text else None) for k, (a, b) in enumerate(pieces, 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["item_kind", "item_id", "cut", "piece", "pieces", "start", "end", "text"])

    return over.mapInArrow(run, OUT)


def rebuilt(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id, text, longest, overlaps) of every item, its text put together again from the pieces without what they have in common.

    longest is the length of its longest piece, overlaps how many different overlaps it has.
    """
    one = F.struct("piece", "start", "end", "text")
    held = pieces.groupBy("item_kind", "item_id").agg(F.array_sort(F.collect_list(one)).alias("all"))  # the pieces of one item
    before = lambda k: F.coalesce(F.get("all", k - 1).end, F.lit(0))
    own = F.transform("all", lambda p, k: F.substring(p.text, before(k) - p.start + 1, F.length(p.text)))
    shared = F.array_distinct(F.filter(F.transform("all", lambda p, k: F.when(k > 0, before(k) - p.start)), lambda n: n.isNotNull()))
    return held.select("item_kind", "item_id", F.array_join(own, "").alias("text"), F.array_max(F.transform("all", lambda p: F.length(p.text))).alias("longest"), shared.alias("overlaps"))
