"""Problem 3: text statistics of every chunk, and the kind (prose, list, table, junk) that follows from them.

Method: the statistics of all chunks go into mergeable quantile sketches (KLL), one per statistic and
language, merged in two steps; by their quantiles every value becomes a percentile and a robust z-score (distance
from the median in units of the interquartile range), and values in a tail are flagged. Which tails mean which kind
is learnt: a softmax regression on the scores and flags, fitted to hand-labelled chunks (at most `labels`).

The language is told by the script that has most letters. One with less than `OWN_SHARE` of all chunks has too few
for quantiles of its own and is scored by those of its family, Chinese for Japanese, Latin for all others.

Common words are those that occur in at least `COMMON` of a language's chunks (words are pairs of characters
in Chinese and stretches of four elsewhere), counted over all chunks, as are rare characters.

Defined results: a null or blank text has all statistics 0 and is junk; a chunk delivered again counts once;
with no labels of at least two kinds, every chunk is prose but the blank ones. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from inkstone.llm.batches import slices
from inkstone.session import materialize

KINDS = ("prose", "list", "table", "junk")
LABELS, COMMON, RARE, BUCKETS = 20_000, 0.02, 0.002, 1 << 17
#: Languages by their script, and the code points of each script but the first two; what has none of them is Latin.
LANGUAGES = ("zh", "ja", "latin", "ko", "cyrillic", "greek", "arabic", "hebrew", "devanagari", "thai")
SCRIPTS = {"ko": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3)), "cyrillic": ((0x400, 0x52F),), "greek": ((0x370, 0x3FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "hebrew": ((0x590, 0x5FF),), "devanagari": ((0x900, 0x97F),), "thai": ((0xE00, 0xE7F),)}
OWN_SHARE = 0.01
STATS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "lines", "lines_ending_in_punctuation", "common_word_share", "rare_character_share", "mean_line_length", "line_length_spread",
    "sentence_ends", "clause_marks", "distinct_character_share", "latin1_share", "longest_run", "case_changes", "marker_lines", "leader_lines", "separators", "number_lines", "number_share", "markup_share", "bracket_share", "cased_share", "space_share", "inline_items",
)
#: Ranks at which the quantiles are taken, and the size of the sketches (their ranks are off by about 0.3 %).
GRID = [k / 1000 for k in range(1001)]
SKETCH = 1024
PARTS = 64

_SPACE, _LINE, _CJK, _LOWER, _UPPER, _DIGIT, _END, _CLAUSE, _OPEN, _LATIN1, _OTHER_LETTER, _SYMBOL = range(12)
MARKER = re.compile(r"(?:[·•●◆■▪*\-–—○◇][ \t]*\S|[（(\[]?(?:\d{1,3}|[一二三四五六七八九十]{1,3}|[a-zA-Z]|[ivx]{1,4})[)）\].、．:：][ \t]*\D|[①-⑳])")
INLINE = re.compile(r"(?:^|[\s；;])(?:\d{1,2}|[a-z]|[一二三四五六七八九十])[)）.、](?=\D)")
LEADER = re.compile(r"(?:\.{3,}|…+|(?:[ ·]\.){3,}|·{3,}|[ \t]{3,}|_{3,})[ \t]*\d{1,4}[ \t]*$", re.M)
CELLS = re.compile(r"\||\t|[ 　\xa0]{2,}|; ?[^;:\n]{1,12}: |,(?=[-\d])|(?<=\d),(?=\d+\.)")
MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*>|&[a-z]+;|\b[a-z]+=|[{}]|\(cid:\d+\)|#[0-9a-f]{6}\b|\bpx\b")


def _classes() -> np.ndarray:
    out = np.full(0x110000, _SYMBOL, np.uint8)
    for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x2E80, 0x2FDF), (0x20000, 0x2FFFF)):
        out[lo : hi + 1] = _CJK
    out[0x80:0x250] = _LATIN1
    out[0x370:0x530] = _OTHER_LETTER
    out[[*range(0x61, 0x7B), *range(0xFF41, 0xFF5B)]] = _LOWER
    out[[*range(0x41, 0x5B), *range(0xFF21, 0xFF3B)]] = _UPPER
    out[[*range(0x30, 0x3A), *range(0xFF10, 0xFF1A)]] = _DIGIT
    out[[ord(c) for c in " \t\r\xa0    　"]] = _SPACE
    out[10] = _LINE
    out[[ord(c) for c in "。！？.!?．"]] = _END
    out[[ord(c) for c in "，、；：,;:"]] = _CLAUSE
    out[[ord(c) for c in "()（）[]【】《》“”‘’\"'「」%％-—+"]] = _OPEN
    out[[0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0xFE00, 0xFE10), *range(0x300, 0x370)]] = _LOWER
    return out


CLASS = _classes()


def _scripts() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)  # 0: no letter of these scripts
    out[np.isin(CLASS, (_LOWER, _UPPER, _LATIN1))] = LANGUAGES.index("latin")
    out[0x3041:0x3100] = LANGUAGES.index("ja")
    for name, spans in SCRIPTS.items():
        for lo, hi in spans:
            out[lo : hi + 1] = LANGUAGES.index(name)
    return out


SCRIPT = _scripts()


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class _Batch:
    """Texts as one array of code points; their classes, rows and languages."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.row = np.repeat(np.arange(self.n), self.sizes)
        self.kind = CLASS[self.codes]
        self.counts = np.bincount(self.row * 12 + self.kind, minlength=self.n * 12).reshape(self.n, 12)
        self.zh = self.counts[:, _CJK] * 3 > self.counts[:, _LOWER] + self.counts[:, _UPPER]

    def languages(self) -> np.ndarray:
        """The number of each text's language in LANGUAGES."""
        seen = np.bincount(self.row * len(LANGUAGES) + SCRIPT[self.codes], minlength=self.n * len(LANGUAGES)).reshape(self.n, -1)
        seen[:, 0] = 0
        ja = seen[:, 1] * 10 >= seen[:, 1] + self.counts[:, _CJK]
        seen[:, 1] = 0
        other = np.where(seen.any(1), seen.argmax(1), LANGUAGES.index("latin"))
        return np.where(self.zh, (ja & (self.counts[:, _CJK] > 0)).astype(int), other)

    def per_row(self, mask: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.row[: len(mask)][mask], weights, minlength=self.n)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and buckets of all words: pairs of characters in Chinese, stretches of four elsewhere."""
        c = np.where(self.kind == _UPPER, self.codes + 32, self.codes).astype(np.uint64)
        c[(self.kind == _SPACE) | (self.kind == _LINE)] = 32
        c[self.kind == _DIGIT] = 48
        letter = (self.kind == _CJK) | (self.kind == _LOWER) | (self.kind == _UPPER) | (self.kind == _LATIN1) | (self.kind == _OTHER_LETTER)
        if len(c) < 4:
            return np.array([], np.int64), np.array([], np.int64)
        two = c[:-3] * np.uint64(0x9E3779B97F4A7C15) + c[1:-2]
        four = (two * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:-1]) * np.uint64(0x165667B19E3779F9) + c[3:]
        zh = self.zh[self.row[:-3]]
        h = np.where(zh, two * np.uint64(0xD6E8FEB86659FD93), four * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - 17)
        good = letter[:-3] & (self.row[:-3] == self.row[3:]) & (letter[1:-2] | ~zh)
        return self.row[:-3][good], h[good].astype(np.int64)


def word_counts(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks per language, chunks with each word bucket per language, chunks with each code point. At most 2 x 131,072 + 65,536 x 17 small rows reach the driver; code points that no chunk has give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(2 + 2 * BUCKETS + 0x110000, np.int64)
        every = ([t for t in batch.column(0).to_pylist() if t] for batch in batches)
        for b in (_Batch(texts[x:y]) for texts in every for x, y in slices(texts)):
            many[:2] += np.array([b.zh.sum(), (~b.zh).sum()])
            row, word = b.words()
            once = _distinct(row * BUCKETS + word)
            at = once // BUCKETS
            many[2 : 2 + 2 * BUCKETS] += np.bincount(np.where(b.zh[at], 0, BUCKETS) + once % BUCKETS, minlength=2 * BUCKETS)
            many[2 + 2 * BUCKETS :] += np.bincount(_distinct(b.row << 21 | b.codes) & ((1 << 21) - 1), minlength=0x110000)
        at = np.nonzero(many)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(many[at])], ["at", "n"])

    counts = chunks.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(2 + 2 * BUCKETS + 0x110000, np.int64)
    found = counts.toArrow()
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out[:2], out[2 : 2 + 2 * BUCKETS].reshape(2, BUCKETS), out[2 + 2 * BUCKETS :]


def statistics(texts: list[str], common: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of non-empty texts, a row each, and the number of each one's language."""
    b = _Batch(texts)
    count = lambda *k: b.counts[:, list(k)].sum(1)
    shown = np.maximum(1, b.sizes - count(_SPACE, _LINE))
    letters = count(_CJK, _LOWER, _UPPER, _LATIN1, _OTHER_LETTER)
    follows = np.concatenate(([False], b.row[1:] == b.row[:-1]))
    group = np.array([0, 0, 1, 2, 2, 3, 4, 4, 4, 2, 2, 5], np.uint8)[b.kind]  # space, CJK, letters, digits, marks, symbols
    new = ~(follows & np.concatenate(([False], group[1:] == group[:-1])))
    runs = b.per_row(new & ((group == 1) | (group == 2)))
    words = np.where(b.zh, count(_CJK) + b.per_row(new & (group == 2)), runs)
    row, word = b.words()
    total = np.bincount(row, minlength=b.n)
    shared = np.bincount(row, common[np.where(b.zh[row], 0, 1), word], minlength=b.n)
    unusual = b.per_row(rare[b.codes])
    distinct = np.bincount(_distinct(b.row << 21 | b.codes) >> 21, minlength=b.n)
    change = b.per_row(np.concatenate(([False], (b.kind[1:] == _UPPER) & (b.kind[:-1] == _LOWER))) & follows)
    solid = (b.kind != _SPACE) & (b.kind != _LINE) & (b.kind != _CJK)
    edge = np.nonzero(np.concatenate(([True], (solid[1:] != solid[:-1]) | ~follows[1:])))[0]
    lengths = np.diff(np.append(edge, len(solid))) * solid[edge]
    longest = np.zeros(b.n)
    np.maximum.at(longest, b.row[edge], lengths)
    before = np.concatenate(([0, 0], b.kind[:-2])) if len(b.kind) > 1 else np.zeros(len(b.kind))
    point = np.concatenate(([False], (b.codes[:-1] == 44) | (b.codes[:-1] == 46))) & (before == _DIGIT)
    number = (b.kind == _DIGIT) & ~(follows & (np.concatenate(([False], b.kind[:-1] == _DIGIT)) | point))
    line = np.cumsum(~follows | (b.kind == _LINE)) - 1
    per_line, long_line, of_row = np.bincount(line, number), np.bincount(line, (b.kind != _LINE) & (b.kind != _SPACE)), b.row[np.nonzero(~follows | (b.kind == _LINE))[0]]
    filled = np.bincount(of_row, long_line > 0, b.n)
    numeric = np.bincount(of_row, (per_line > 0) & (per_line * 24 > long_line), b.n) / np.maximum(1, filled)
    figures = b.per_row(number)
    lines, ends, mean, spread, marked, leaders, cells, markup, inline = (np.zeros(b.n) for _ in range(9))
    for k, text in enumerate(texts):
        own = [x for x in map(str.strip, text.split("\n")) if x] or [""]
        sizes = [len(x) for x in own]
        lines[k] = m = len(own)
        ends[k] = sum(x[-1:] in "。！？.!?．…”\"」" or x[-1:] in ")）" and len(x) > 24 for x in own) / m
        mean[k] = sum(sizes) / m
        inner = sizes[:-1] if m > 2 else sizes  # the last line of a paragraph is short
        spread[k] = (max(inner) - min(inner)) / max(1, max(inner))
        marked[k] = sum(MARKER.match(x) is not None for x in own) / m
        # The plain tests before the patterns only save time: without these characters no pattern matches.
        if "..." in text or "…" in text or "··" in text or "   " in text or " ." in text or "__" in text or "\t" in text:
            leaders[k] = len(LEADER.findall(text)) / m
        if "|" in text or "\t" in text or "  " in text or "; " in text or ";" in text or "," in text or "\u3000" in text or "\xa0" in text:
            cells[k] = len(CELLS.findall(text)) / m
        if "<" in text or "&" in text or "=" in text or "{" in text or "}" in text or "#" in text or "(cid" in text or "px" in text:
            markup[k] = sum(map(len, MARKUP.findall(text)))
        if ")" in text or "）" in text or "、" in text or ". " in text or "." in text:
            inline[k] = len(INLINE.findall(text))
    values = [
        words, letters / np.maximum(1, runs), count(_SYMBOL) / shown, count(_DIGIT) / shown, lines, ends, shared / np.maximum(1, total), unusual / shown, mean, spread,
        count(_END) / shown, count(_CLAUSE) / shown, distinct / np.maximum(1, b.sizes), count(_LATIN1, _OTHER_LETTER) / shown, longest, change / np.maximum(1, letters), marked, leaders, cells, numeric, figures / np.maximum(1, words + figures), markup / shown, count(_OPEN) / shown,
        count(_UPPER) / np.maximum(1, letters), count(_SPACE) / np.maximum(1, b.sizes), inline,
    ]
    return np.stack(values, 1).astype(np.float32), b.languages()


def described(chunks: DataFrame) -> DataFrame:
    """(chunk_id, chunk_type, blank, language, one column per statistic); written to the shared folder."""
    several, words, chars = word_counts(chunks)
    common = words >= COMMON * np.maximum(1, several)[:, None]
    rare = chars < RARE * max(1, several.sum())
    rare[np.arange(0x20, 0x7F)] = False
    packed = np.packbits(common), np.packbits(rare)
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("chunk_type", T.StringType()), T.StructField("blank", T.BooleanType()), T.StructField("language", T.StringType()), *(T.StructField(s, T.FloatType()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(packed[0]).astype(float).reshape(2, BUCKETS)
        seldom = np.unpackbits(packed[1]).astype(bool)[:0x110000]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            blank = [not t or not t.strip() for t in texts]
            values = np.zeros((len(texts), len(STATS)), np.float32)
            language = np.full(len(texts), LANGUAGES.index("latin"))
            some = [k for k, x in enumerate(blank) if not x]
            full = [texts[k] for k in some]
            for x, y in slices(full):
                values[some[x:y]], language[some[x:y]] = statistics(full[x:y], frequent, seldom)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blank), pa.array(np.array(LANGUAGES, object)[language], pa.string()), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATS)))], schema.names)

    return materialize(chunks.where("chunk_id is not null").select("chunk_id", "chunk_type", "text").mapInArrow(run, schema))


def family(language: str) -> str:
    return "zh" if language in ("zh", "ja") else "latin"


def quantiles(stats: DataFrame, own_only: bool = False) -> dict[str, np.ndarray]:
    """Per language a row of quantiles at GRID for each statistic, from KLL sketches. A row per language (ten at most) reaches the driver.

    Each language's chunks are sketched in parts, whose sketches are then merged; families from the languages' sketches.
    """
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).alias("part")
    parts = stats.where("not blank").groupBy("language", part).agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_float(s, SKETCH).alias(s) for s in STATS))
    own = materialize(parts.groupBy("language").agg(F.sum("n").alias("n"), *(F.kll_merge_agg_float(s, SKETCH).alias(s) for s in STATS)))
    joint = own.groupBy(F.when(F.col("language").isin("zh", "ja"), "zh").otherwise("latin").alias("family")).agg(*(F.kll_merge_agg_float(s, SKETCH).alias(s) for s in STATS))
    points = F.array(*(F.lit(q) for q in GRID))
    at = [F.kll_sketch_get_quantile_float(s, points).alias(s) for s in STATS]
    read = lambda r: np.array([list(r[s]) for s in STATS], float)
    rows = own.select("language", "n", *at).collect()
    pooled = {r.family: read(r) for r in joint.select("family", *at).collect()}
    total = sum(r.n for r in rows)
    return {r.language: read(r) if r.n >= OWN_SHARE * total else pooled[family(r.language)] for r in rows if not own_only or r.n >= OWN_SHARE * total}


def rank_errors(stats: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """(language, statistic, n, error): by how much the quantiles' ranks are off at most, by exact counts of all chunks in one reading.

    Languages that are scored by their family's quantiles are left out. n and error are of at most ten languages.
    """
    names = sorted(known)
    schema = "language string, statistic string, at int, below bigint, upto bigint"
    points = len(GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(names), len(STATS), points + 1), np.int64)
        for batch in batches:
            language, blank = np.array(batch.column("language").to_pylist(), object), batch.column("blank").to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                mine = (language == name) & ~blank
                for k, s in enumerate(STATS if mine.any() else ()):
                    v = batch.column(s).to_numpy(zero_copy_only=False)[mine]
                    for side, how in enumerate(("right", "left")):  # a value counts below the points beyond it, and up to those it reaches
                        seen[side, i, k] += np.bincount(np.searchsorted(known[name][k], v, how), minlength=points + 1)
        i, k, at = np.nonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i], pa.string()), pa.array([STATS[x] for x in k], pa.string()), pa.array(at.astype(np.int32)), *(pa.array(seen[side, i, k, at]) for side in (0, 1))], ["language", "statistic", "at", "below", "upto"])

    counts = stats.mapInArrow(run, schema).groupBy("language", "statistic", "at").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points)), lambda j: F.struct(j.alias("at"), (j / F.lit(points - 1)).alias("rank")))).alias("g")
    every = counts.groupBy("language", "statistic").agg(F.sum("upto").alias("n")).select("*", grid).select("language", "statistic", "n", "g.*")
    by = W.partitionBy("language", "statistic").orderBy("at")  # a thousand rows
    sums = every.join(counts, ["language", "statistic", "at"], "left").fillna(0, ["below", "upto"]).withColumn("below", F.sum("below").over(by) / F.col("n")).withColumn("upto", F.sum("upto").over(by) / F.col("n")).where(F.col("at") < points)
    return sums.groupBy("language", "statistic", "n").agg(F.max(F.greatest(F.lit(0.0), F.col("below") - F.col("rank"), F.col("rank") - F.col("upto"))).alias("error"))


def percentiles(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Ranks of values by the quantiles at GRID: between two quantiles in a straight line, of a value that several have the middle."""
    grid = np.array(GRID)
    lo, hi = np.searchsorted(q, v, "left"), np.searchsorted(q, v, "right")
    between = np.interp(v, q, grid, left=0.0, right=1.0)
    return np.where(hi > lo, (grid[np.minimum(lo, len(grid) - 1)] + grid[np.maximum(hi - 1, 0)]) / 2, between)


def scores(values: np.ndarray, language: np.ndarray, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Percentiles and robust z-scores of rows of statistics."""
    percent, z = np.full(values.shape, 0.5), np.zeros(values.shape)
    middle, low, high, p005, p05, p95, p995 = (GRID.index(x) for x in (0.5, 0.25, 0.75, 0.005, 0.05, 0.95, 0.995))
    for name, q in known.items():
        at = language == name
        if not at.any():
            continue
        for k in range(values.shape[1]):
            v = values[at, k].astype(float)
            percent[at, k] = percentiles(v, q[k])
            scale = (q[k, high] - q[k, low]) / 1.349
            if scale <= 0:
                scale = (q[k, p95] - q[k, p05]) / 3.29
            if scale <= 0:
                scale = max(abs(q[k, middle]) / 4, (q[k, p995] - q[k, p005]) / 4, 0.01)
            z[at, k] = (v - q[k, middle]) / scale
    return percent, z


def tails(percent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the low, and in the high, tail of 2.5 %."""
    return percent < 0.025, percent > 0.975


def design(percent: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Scores and tail flags as a matrix for the regression."""
    low, high = tails(percent)
    z = np.clip(z, -30, 30)
    soft = np.sign(z) * np.log1p(np.abs(z))
    return np.concatenate([soft, np.clip(z, -3, 3) / 3, z > 3, z < -3, high, low, z > 8, np.ones((len(z), 1))], 1).astype(float)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 600, l2: float = 2e-3) -> np.ndarray:
    """Softmax regression by Adam on all rows."""
    w, m, v = (np.zeros((x.shape[1], len(KINDS))) for _ in range(3))
    target = np.eye(len(KINDS))[y]
    for t in range(1, steps + 1):
        p = np.exp((s := x @ w) - s.max(1, keepdims=True))
        g = x.T @ (p / p.sum(1, keepdims=True) - target) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def learn(stats: DataFrame, labels: DataFrame, known: dict[str, np.ndarray], most: int = LABELS) -> np.ndarray | None:
    marked = labels.where(F.col("kind").isin(*KINDS) & F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("kind").alias("kind")).orderBy(F.xxhash64("chunk_id")).limit(most)
    rows = stats.where("not blank").join(F.broadcast(marked), "chunk_id").dropDuplicates(["chunk_id"]).orderBy("chunk_id").select("kind", "language", *STATS).toPandas()  # at most `most` labels
    if rows.kind.nunique() < 2:
        return None
    x = design(*scores(rows[list(STATS)].to_numpy(), rows.language.to_numpy(), known))
    return fit(x, np.array([KINDS.index(k) for k in rows.kind]))


def kinds(stats: DataFrame, labels: DataFrame, with_scores: bool = False) -> DataFrame:
    """(chunk_id, chunk_type, kind), with percentiles, z-scores and tail flags of each statistic if wanted."""
    known = quantiles(stats)
    w = learn(stats, labels, known)
    each = {"percentile": T.FloatType(), "z": T.FloatType(), "low": T.BooleanType(), "high": T.BooleanType()}
    more = [T.StructField(f"{s}_{x}", kind) for s in STATS for x, kind in each.items()] if with_scores else []
    keep = ["chunk_id", "chunk_type", *(["language", *STATS] if with_scores else [])]
    schema = T.StructType([*(stats.schema[c] for c in keep), *more, T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], 1)
            percent, z = scores(values, np.array(batch.column("language").to_pylist(), object), known)
            best = (design(percent, z) @ w).argmax(1) if w is not None else np.zeros(len(z), int)
            best = np.where(batch.column("blank").to_numpy(zero_copy_only=False), KINDS.index("junk"), best)
            flags = tails(percent)
            extra = [pa.array(np.ascontiguousarray(m[:, k])) for k in range(len(STATS)) for m in (percent.astype(np.float32), z.astype(np.float32), *flags)] if with_scores else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *extra, pa.array(np.array(KINDS, object)[best], pa.string())], schema.names)

    return stats.mapInArrow(run, schema)


def not_prose(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    found = kinds(described(chunks), labels)
    return found.where("(chunk_type is null or chunk_type = 'text') and kind <> 'prose'").select("chunk_id", "kind").distinct()
