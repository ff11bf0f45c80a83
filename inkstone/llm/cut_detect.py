"""Problem 8: texts that were cut off, and how often each source cuts.

Method: intact texts (those with a sentence end at their end) are cut artificially, at their source's limit
or elsewhere inside a sentence, which gives the positives; the values as they are give the negatives. A
logistic regression on hashed features of the closing characters, the closing line, its punctuation and the
length's distance to limits is trained on them, trained again (twice) without the negatives it takes for cut,
and scores every record.

A source's limits are the lengths that far more of its values have than neighbouring lengths: they are
counted over all documents. The features are of how a text ends, so they are taken from its last `TAIL` characters
and its length; nothing before these is looked at. Training takes the documents
with a hash under a bound that lets about `sample` of them through, and no more than `sample`.

Defined results: a null or blank text is not cut (score 0); a document delivered again counts once, a null
source is one source of its own; without any intact text nothing is cut. Extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

#: Documents the model is trained on, about and at most.
SAMPLE = 10_000
#: Values as they are that score at least this are left out when the model is trained again.
DOUBT = 0.35
TAIL = 240
BITS = 18
TERMINAL = "。！？.!?．"
CLOSE = "\"'”’）)】]》〉」』"
SENTENCE = re.compile(rf"[。！？]|[.!?．](?=\s|$)")
#: What a cut leaves behind; half of the artificial cuts leave nothing.
CUT_ENDS = ("", "", "", "", "", "…", "...", "……", "…", "�")


def _kind(c: str) -> str:
    if c.isdigit():
        return "9"
    if c.isspace():
        return "_"
    if c.isalpha():
        return ("A" if c.isupper() else "a") if ord(c) < 0x250 else "字"
    return c


def _bucket(n: int) -> int:
    return n if n < 4 else n.bit_length() * 4 + (n >> (n.bit_length() - 2)) % 2


def features(tail: str, size: int, limits: tuple[int, ...]) -> list[str]:
    """Names of the features of a value that ends with tail and has size characters."""
    text = tail.rstrip()
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    last, before = lines[-1].strip(), lines[-2].strip() if len(lines) > 1 else ""
    shape = "".join(map(_kind, last))
    runs = re.sub(r"(.)\1+", r"\1+", shape)
    ends = [m.end() for m in SENTENCE.finditer(last)]
    rest = last[ends[-1] :] if ends else last
    whole = len(lines) > 1 or size <= len(tail)  # is the closing line seen from its start?
    label = re.match(r"[^：:，,。]{1,16}[：:]", last) if whole else None
    near = min((abs(size - x) for x in limits), default=99)
    own = re.match(r"\W?\w{0,3}[)）.、]|[·•●◆■\-*|]", last) is not None
    number = len(text) - len(text.rstrip("0123456789"))
    prose = number < 12 and (bool(ends) or len(last) > 60 or "，" in last or not whole)  # no sentence has so long a number
    tail_shape = "".join(map(_kind, rest[-4:]))
    return [
        "bias", f"c1 {text[-1:]}" if not text[-1:].isalnum() else f"k1 {_kind(text[-1:])}", f"s4 {tail_shape}", f"c2 {text[-2:]}", f"c3 {text[-3:]}", f"terminal {text[-1:] in TERMINAL} {text.rstrip(CLOSE)[-1:] in TERMINAL}",
        f"runs {runs[:24]}" if whole else "long", f"runs end {runs[-8:]} {prose}", f"label {label.group(0)[:12]}" if label else "no label", f"labelled {bool(label)} {bool(ends)} {_kind(text[-1:])}", f"start {last[:2]}" if whole else "mid",
        f"prose {prose} {_kind(text[-1:])}", f"line {_bucket(len(last))} {bool(ends)}", f"rest {_bucket(len(rest))}", f"rest {min(_bucket(len(rest)), 20)} {prose}", f"commas {min(3, len(re.findall('[，,;；]', rest)))} {prose}", f"before {before[-1:] in TERMINAL} {prose} {own}",
        f"item {own} {bool(re.match(r'[·•●◆■|*-]|.{0,3}[)）.、]', before))}", f"open {rest.count('（') + rest.count('(') > rest.count('）') + rest.count(')')}", f"near {min(near, 4)}", f"near {near == 0} {text[-1:] in TERMINAL}", f"at limit {near == 0} prose {prose} {_kind(text[-1:])}", f"round {size % 100 == 0 or size % 256 == 0}",
        f"number {_bucket(min(number, 12))} {prose}", f"digits {min(4, sum(c.isdigit() for c in rest[-30:]) // 4)} {prose}", f"words {min(6, len(rest.split()))} {prose} {_kind(text[-1:])}", f"lines {min(3, len(lines))} {prose}", f"blank {tail[len(text):].count(chr(10)) > 0} {tail[-1:] == ' '}",
    ]


def hashed(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names], np.int32)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 6, seed: int = 1) -> np.ndarray:
    """Weights of a logistic regression over hashed features; both classes weigh the same. Adagrad."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    if not len(rows) or labels.min() == labels.max():
        return w
    x, y = np.stack(rows), labels.astype(float)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            b = order[k : k + 64]
            p = 1 / (1 + np.exp(-np.clip(w[x[b]].sum(1), -30, 30)))
            at, inverse = np.unique(x[b].ravel(), return_inverse=True)
            grad = np.bincount(inverse, np.repeat((p - y[b]) * weight[b], x.shape[1]), len(at)) / len(b) + 1e-6 * w[at]
            g2[at] += grad**2
            w[at] -= 0.1 * grad / np.sqrt(g2[at])
    return w


def score(w: np.ndarray, row: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[row].sum(), -30, 30))))


def endings(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, size, tail, text): all that is looked at, from one reading of the documents; written to the shared folder.

    text is whole for about `sample` documents, those with a hash under a bound, and null for the others. Documents
    without an id are there for the lengths alone.
    """
    share = min(1.0, sample / max(1, documents.count()))  # the files' own counts
    drawn = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    return materialize(documents.select("doc_id", "source", F.length("text").alias("size"), F.expr(f"right(text, {TAIL})").alias("tail"), F.when(drawn, F.col("text")).alias("text")))


def length_counts(ends: DataFrame) -> DataFrame:
    """(source, size, n) of all texts."""
    return ends.where("size is not null").groupBy(F.coalesce("source", F.lit("")).alias("source"), "size").agg(F.count(F.lit(1)).alias("n"))


def length_limits(counts: DataFrame, least: int = 4) -> dict[str, tuple[int, ...]]:
    """Lengths that stand out in each source, over all documents; a row per source reaches the driver.

    A length stands out if at least `least` values, and 8 times as many as on average within 50 characters of it,
    have it; kept are all that have at least a quarter of the values of the source's most frequent one.
    """
    band = counts.withColumn("band", F.explode(F.array(F.floor(F.col("size") / 50) - 1, F.floor(F.col("size") / 50), F.floor(F.col("size") / 50) + 1))).groupBy("source", "band").agg(F.sum("n").alias("around"))
    peaks = counts.where(F.col("n") >= least).withColumn("band", F.floor(F.col("size") / 50)).join(band, ["source", "band"]).where(F.col("n") - 1 > 8 * (F.col("around") - F.col("n")) / 149)
    top = peaks.groupBy("source").agg(F.max("n").alias("most"))
    kept = peaks.join(top, "source").where(F.col("n") * 4 >= F.col("most")).groupBy("source").agg(F.collect_list("size").alias("sizes"))
    return {r.source: tuple(sorted(r.sizes)) for r in kept.collect()}


def _sample(ends: DataFrame, limits: dict[str, tuple[int, ...]], sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and labels: the values as they are, and artificially cut ones."""
    row = F.create_map(*(F.lit(x) for kv in limits.items() for x in (kv[0], kv[1][-1]))) if limits else F.create_map().cast("map<string,int>")
    size = F.length("text")
    limit = F.coalesce(F.try_element_at(row, F.coalesce("source", F.lit(""))), F.lit(0))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.lit(1000)) / 1000
    cut = F.when((limit > 0) & (limit < size) & (F.pmod(F.xxhash64("doc_id", F.lit("at")), F.lit(2)) == 0), limit).otherwise((size * (0.3 + 0.69 * dice)).cast("int"))
    rows = (
        ends.where(F.length(F.trim("text")) > 0).withColumn("cut", cut)
        .select("source", "tail", size.alias("size"), "cut", F.expr(f"substring(text, greatest(cut - {TAIL}, 0) + 1, least(cut, {TAIL}))").alias("head"), F.expr("substring(text, cut + 1, 3)").alias("next"), F.xxhash64("doc_id").alias("h"), "doc_id")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r.h, r.doc_id))[:sample]
    x, y = [], []
    for k, r in enumerate(rows):
        own = limits.get(r.source or "", ())
        x.append(hashed(features(r.tail, r.size, own)))
        y.append(0)
        end = r.tail.rstrip().rstrip(CLOSE)[-1:]
        if end not in TERMINAL or not end or r.tail.rstrip().endswith(("..", "…")) or r.size in own or r.cut < 20:
            continue
        inside = r.head.rstrip()
        number = inside[-1:] == "." and inside[-2:-1].isdigit() and r.next[:1].isdigit()
        if not inside or inside.rstrip(CLOSE)[-1:] in TERMINAL and not number or not r.next.strip() or r.next[0] == "\n" or inside[-1] == "\n" or r.next.lstrip()[0] in TERMINAL + CLOSE:
            continue  # not inside a sentence
        line = inside.rsplit("\n", 1)[-1]
        if len(line) < 20 and "\n" in inside and not re.search("[，,。]", line + r.next):
            continue  # perhaps a list or a table
        rest = CUT_ENDS[r.h % len(CUT_ENDS)]  # within the limit
        x.append(hashed(features(r.head[: len(r.head) - len(rest)] + rest, r.cut, own)))
        y.append(1)
    return x, np.array(y)


def fit(ends: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, tuple[int, ...]]]:
    limits = length_limits(length_counts(ends))
    x, y = _sample(ends, limits, sample)
    w = train(x, y)
    for turn in range(2 if len(x) and y.any() else 0):
        sure = [k for k in range(len(x)) if y[k] or score(w, x[k]) < DOUBT]
        w = train([x[k] for k in sure], y[sure], seed=2 + turn)
    return w, limits


def scored(ends: DataFrame, model: tuple[np.ndarray, dict[str, tuple[int, ...]]], at: float = 0.5) -> DataFrame:
    """(doc_id, source, score, cut) of every document."""
    w, limits = model
    known = np.nonzero(w)[0].astype(np.int32)
    values = w[known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[known] = values
        for batch in batches:
            ids, sources, tails, sizes = (c.to_pylist() for c in batch.columns)
            p = [score(weights, hashed(features(t, n, limits.get(s or "", ())))) if t and t.strip() and len(known) else 0.0 for s, t, n in zip(sources, tails, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array([x >= at for x in p])], ["doc_id", "source", "score", "cut"])

    return ends.where("doc_id is not null").select("doc_id", "source", "tail", "size").mapInArrow(run, "doc_id bigint, source string, score double, cut boolean")


def cut_texts(documents: DataFrame) -> DataFrame:
    """scored() by a model fitted to the documents themselves."""
    ends = endings(documents)
    return scored(ends, fit(ends))


def rates(scores: DataFrame) -> DataFrame:
    once = scores.groupBy("doc_id", "source").agg(F.bool_or("cut").alias("cut"))
    return once.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut_documents"), F.avg(F.col("cut").cast("int")).alias("cut_rate"))
