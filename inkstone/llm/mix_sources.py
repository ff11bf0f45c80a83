"""Problem 7: a mixture of sources in target shares, small sources repeated at most a capped number of times.

Method: weighted fair queueing. Documents are shuffled by a seeded hash of their id; a copy's virtual finish
time is the tokens its source has given up to its end, divided by the source's weight. Copies are sorted by
finish time over the whole range and cut off where the budget is reached. Every copy of a source's documents
is given before any document is given again.

The running sums are made in two steps (sums of hash ranges, then rows within a range), so no source, however
large, is summed in one task; only the copies around the cut-off are ordered in one window, about one
document per source to either side.

Defined results: documents without an id or a source, or of a source without a positive share, are not used,
but their tokens count for the default budget (all tokens). A null or empty text has no tokens and is not
used. A document delivered again counts once (the latest by fetched_at). A null max_repeats is 1. A source
without documents has 0 tokens. Ties in finish time go by source, id and copy. Extra columns are left out.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from inkstone.session import materialize, small

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that belongs to the rank file and splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hash ranges a source is summed in.
RANGES = 4096
#: Rows of targets, and of sums of ranges, up to which a join broadcasts them; beyond, it shuffles.
TARGETS, SUMS = 10_000, 200_000
_encoders: dict[str, object] = {}
_SURROGATE = re.compile("[\ud800-\udfff]")


def encoder(path: str):
    """The tokenizer of a rank file that was sent along, loaded once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(SparkFiles.get(os.path.basename(path)), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def send(spark: SparkSession, path: str) -> None:
    """The driver's rank file goes to the workers, which need not have it; a second time this does nothing."""
    sent = spark.sparkContext.__dict__.setdefault("_inkstone_sent", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)


def with_tokens(df: DataFrame, column: str = "text", into: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df without its text, with the number of tokens of it (0 for a null)."""
    send(df.sparkSession, tokenizer)
    keep = [c for c in df.columns if c not in (column, into)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], [*keep, into])

    return df.select(column, *keep).mapInArrow(run, schema)


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), each document once, and a row without id and source for all without an id; written to the shared folder."""
    sized = with_tokens(documents.select("doc_id", "source", "fetched_at", "text"), tokenizer=tokenizer)
    latest = sized.groupBy("doc_id").agg(F.max_by(F.struct("source", "tokens"), F.struct("fetched_at", "tokens", "source")).alias("x"), F.sum("tokens").alias("all"))
    known = F.col("doc_id").isNotNull()
    return materialize(latest.select("doc_id", F.when(known, F.col("x.source")).alias("source"), F.when(known, F.col("x.tokens")).otherwise(F.col("all")).alias("tokens")))


def schedule(sized: DataFrame, targets: DataFrame, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """(source, doc_id, tokens, through, total, target_share, max_repeats): tokens given through the document in a round, and in a round."""
    weights = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.where("doc_id is not null and tokens > 0").join(small(weights, TARGETS), "source").withColumn("place", place).withColumn("range", F.pmod("place", F.lit(ranges)))
    sums = rows.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    by = W.partitionBy("source").orderBy("range")  # at most `ranges` rows a source
    sums = materialize(sums.withColumn("before", F.sum("in_range").over(by) - F.col("in_range")).withColumn("total", F.sum("in_range").over(W.partitionBy("source"))))
    inside = W.partitionBy("source", "range").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum("tokens").over(inside)).join(small(sums, SUMS), ["source", "range"]).select("source", "doc_id", "tokens", (F.col("before") + F.col("inside")).alias("through"), "total", "target_share", "max_repeats")


def ledger(planned: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """Per source of the targets its tokens and last virtual finish time; short: it ends before its share of the budget."""
    last = planned.groupBy("source").agg(F.max("through").alias("tokens"), F.count("*").alias("documents"), F.max((F.col("total") * (F.col("max_repeats") - 1) + F.col("through")) / F.col("target_share")).alias("last_finish"))
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    out = rows.join(last, "source", "left").fillna(0, ["tokens", "documents"]).fillna(0.0, ["last_finish"])
    return out.withColumn("short", (F.col("last_finish") < F.lit(float(budget))) | (F.col("max_repeats") < 1))


def _virtual_time(rows: list, tokens: float) -> float:
    """When the queues have given so many tokens in all, documents taken as divisible."""
    left, at, time = sorted(rows, key=lambda r: r.last_finish), tokens, 0.0
    weight = sum(r.target_share for r in left)
    for r in left:
        step = (r.last_finish - time) * weight
        if step >= at:
            return time + at / weight
        at, time, weight = at - step, r.last_finish, weight - r.target_share
    return time if at <= 0 else float("inf")


def mixture(planned: DataFrame, book: DataFrame, budget: int) -> DataFrame:
    """The copies selected, sorted by finish time: (finish, source, doc_id, copy, tokens)."""
    rows = [r for r in book.collect() if r.tokens > 0 and r.max_repeats > 0]  # a row per source
    slack = sum(r.largest for r in planned.groupBy("source").agg(F.max("tokens").alias("largest")).collect()) if rows else 0
    low, high = _virtual_time(rows, max(0, budget - slack)), _virtual_time(rows, budget + slack)
    most = F.ceil(F.lit(min(high, 1e300)) * F.col("target_share") / F.col("total")) + 1
    copies = planned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("max_repeats").cast("bigint"), most)).cast("int"))))
    copies = copies.where("copy <= max_repeats").withColumn("finish", (F.col("total") * (F.col("copy") - 1) + F.col("through")) / F.col("target_share")).select("finish", "source", "doc_id", "copy", "tokens")
    sure = copies.where(F.col("finish") <= low)
    given = sure.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    order = ["finish", "source", "doc_id", "copy"]
    edge = copies.where((F.col("finish") > low) & (F.col("finish") <= high))  # about two documents a source
    edge = edge.withColumn("so_far", F.sum("tokens").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + F.lit(given)).where(F.col("so_far") <= budget).drop("so_far")
    return sure.unionByName(edge).orderBy(*order)


def shares(selected: DataFrame, book: DataFrame) -> DataFrame:
    """The ledger with the tokens selected and the shares in fact reached."""
    got = selected.groupBy("source").agg(F.sum("tokens").alias("selected_tokens"), F.count("*").alias("copies"))
    out = book.join(got, "source", "left").fillna(0, ["selected_tokens", "copies"])
    return out.withColumn("actual_share", F.col("selected_tokens") / F.greatest(F.sum("selected_tokens").over(W.partitionBy()), F.lit(1)))  # a row per source


def budget_of(sized: DataFrame) -> int:
    return int(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
