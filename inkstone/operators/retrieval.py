"""Retrieval: encoders, exact and clustered vector search, BM25, fusion, reranking, and checks of answers.

Defined results: null texts have no tokens and a vector of zeros; null or empty vectors are not searched; ties
in score go by id; fewer rows than k give all of them. Searches take the query set in blocks, one pass over the
rows each: every task keeps k rows per query, so k rows per query and task are shuffled.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from inkstone.functions.vectors import l2_normalize
from inkstone.session import fence, materialize, small

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class EncoderConfig:
    """How texts become vectors. `load` makes a model, once per worker: load(model_name, query_instruction_for_retrieval=, use_fp16=), or with fewer arguments if it takes no more."""

    load: Callable[..., object] | None = None
    model_name: str = "BAAI/bge-large-zh-v1.5"
    batch_size: int = 16
    max_length: int = 512
    normalize: bool = True
    use_fp16: bool = False
    # Fixed value: the instruction that the default model was trained with.
    query_instruction: str = "为这个句子生成表示以用于检索相关文章："
    dimensions: int = 256


class HashingEncoder:
    """The built-in stand-in for a model: signed hashes of character pairs and words of whole texts, however long."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def encode(self, texts: list[str], batch_size: int = 16, max_length: int = 512, normalize_embeddings: bool = False) -> np.ndarray:
        texts = [" ".join(t.lower().split()) for t in texts]
        codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # with the blank after it
        row = np.repeat(np.arange(len(texts)), sizes)[: len(codes)]
        blank = codes == 33
        pair = row[1:] == row[:-1] if len(codes) else np.zeros(0, bool)
        hashes, rows = [_scatter(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])[pair & ~blank[1:] & ~blank[:-1]]] if len(codes) else [], [row[:-1][pair & ~blank[1:] & ~blank[:-1]]] if len(codes) else []
        if (~blank).any():
            start = np.nonzero(~blank & np.concatenate(([True], blank[:-1])))[0]
            place = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes)))) if start[0] == 0 else np.arange(len(codes)) - np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(codes))))))
            spelled = np.where(blank, np.uint64(0), _scatter(codes * np.uint64(0xC2B2AE3D27D4EB4F) + place.astype(np.uint64)))
            hashes.append(_scatter(np.add.reduceat(spelled, start)))
            rows.append(row[start])
        h, r = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, rows))
        at = r.astype(np.int64) * self.dimensions + (h % np.uint64(self.dimensions)).astype(np.int64)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        return np.bincount(at, sign, minlength=len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(np.float32)


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class Encoder:
    """A model behind one interface, whichever of the usual methods and arguments it has.

    Queries go to encode_queries, else encode; passages to encode_corpus, else encode. A method that does not take
    all arguments gets the batch size alone, and its vectors are scaled here. No texts give no vectors.
    """

    def __init__(self, config: EncoderConfig) -> None:
        self.config = config
        self.model = HashingEncoder(config.dimensions) if config.load is None else self._loaded()

    def _loaded(self) -> object:
        c = self.config
        attempts = (((c.model_name,), {"query_instruction_for_retrieval": c.query_instruction, "use_fp16": c.use_fp16}), ((c.model_name,), {"use_fp16": c.use_fp16}), ((), {}))
        for args, named in attempts:
            try:
                inspect.signature(c.load).bind(*args, **named)
            except TypeError:
                continue
            except ValueError:  # a callable without a signature
                pass
            return c.load(*args, **named)
        raise RuntimeError("the model cannot be loaded with any of the known arguments")

    def encode(self, texts: list[str], queries: bool = False) -> np.ndarray:
        if not texts:
            return np.zeros((0, 0), np.float32)
        c, error = self.config, None
        for name in ("encode_queries" if queries else "encode_corpus", "encode"):
            if (method := getattr(self.model, name, None)) is None:
                continue
            for named in ({"batch_size": c.batch_size, "max_length": c.max_length, "normalize_embeddings": c.normalize}, {"batch_size": c.batch_size}, {}):
                try:
                    vectors = np.asarray(method(texts, **named), np.float32)
                except TypeError as this:
                    error = this
                    continue
                return scaled(vectors) if c.normalize else vectors
        raise RuntimeError("the model has no method that encodes texts") from error


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; one of zeros stays as it is."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def encoded(df: DataFrame, column: str, config: EncoderConfig = EncoderConfig(), queries: bool = False, into: str = "embedding") -> DataFrame:
    """df with the vectors of a text column, batch by batch; the filter on blank texts belongs before it."""
    keep = [c for c in df.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder(config)
        for batch in batches:
            texts = [t or "" for t in batch.column(keep.index(column)).to_pylist()]
            parts = [model.encode(list(part), queries) for part in batched(texts, config.batch_size * 64)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, config.dimensions), np.float32)
            flat = pa.array(np.ascontiguousarray(vectors, np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * (vectors.shape[1] if len(vectors) else 0), pa.int32()), flat)], [*keep, into])

    kept = df.select(*keep)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))]))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one size as a matrix."""
    if len(column) and (np.diff(column.offsets.to_numpy()) != size).any():
        raise ValueError(f"a vector has not {size} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(float)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores, ties by id, with every tie at the edge looked at."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= edge)[0]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def same_size(rows: DataFrame) -> int:
    """The number of dimensions that all vectors have; an error if there are none or if they differ."""
    low, high = rows.where("size(embedding) > 0").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low is None or low != high:
        raise ValueError(f"vectors must have one size, not {low} to {high}" if low else "there are no vectors")
    return low


def vector_topk(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = 2_000) -> DataFrame:
    """(query_id, rank, id, score): exact best inner products. rows: id, embedding; queries: query_id, embedding.

    Queries reach the workers in blocks of `block`.
    """
    out = None
    usable = rows.where("id is not null and size(embedding) > 0").select("id", "embedding")
    for part in batched((tuple(r) for r in queries.where("query_id is not null and size(embedding) > 0").select("query_id", "embedding").orderBy("query_id").toLocalIterator()), block):
        names, matrix = np.array([p[0] for p in part]), np.array([p[1] for p in part], float)

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], np.int64), np.array([]))] * len(names)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = _matrix(batch.column(1), matrix.shape[1])
                for q, scores in enumerate(matrix @ vectors.T):
                    at = _best(ids, scores, k)
                    both = np.concatenate((best[q][0], ids[at])), np.concatenate((best[q][1], scores[at]))
                    at = _best(*both, k)
                    best[q] = both[0][at], both[1][at]
            sizes = [len(b[0]) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes), pa.int64()), pa.array(np.concatenate([b[0] for b in best]), pa.int64()), pa.array(np.concatenate([b[1] for b in best]), pa.float64())], ["query_id", "id", "score"])

        found = usable.mapInArrow(run, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double")
    return ranked(out, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: (query_id, rank, id, score)."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ivf_centres(rows: DataFrame, cells: int = 16, sample: int = 50_000, seed: int = 1) -> np.ndarray:
    """The centres of coarse cells, fitted by k-means on about `sample` rows at most; none without rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = rows.where("id is not null and size(embedding) > 0")
    if not (n := usable.count()):
        return np.zeros((0, 0))
    share = min(1.0, sample / n)
    some = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="v").fit(some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v")))
    return np.array(model.clusterCenters())


def save_ivf(rows: DataFrame, path: str, cells: int = 16, sample: int = 50_000, seed: int = 1) -> None:
    """An index in a folder: every row under its cell (a directory each), and the centres."""
    spark, centres = rows.sparkSession, ivf_centres(rows, cells, sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), centres.shape[1])
            near = ((centres**2).sum(1) - 2 * v @ centres.T).argmin(1) if len(v) else np.array([], int)  # no rows without centres
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["id", "embedding", "cell"])

    placed = rows.where("id is not null and size(embedding) > 0").select("id", "embedding").mapInArrow(run, "id bigint, embedding array<float>, cell int")
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")  # a large cell is written by several tasks
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def ivf_topk(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = 12, block: int = 2_000) -> DataFrame:
    """vector_topk over the `probes` cells of a saved index whose centres are nearest to each query; the other cells' files are not read.

    Rows in other cells are missed; README has the recall.
    """
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # a row per cell
    if not len(centres):
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    rows, out = spark.read.parquet(f"{path}/rows"), None
    for part in batched((tuple(r) for r in queries.where("query_id is not null and size(embedding) > 0").select("query_id", "embedding").orderBy("query_id").toLocalIterator()), block):
        names, matrix = np.array([p[0] for p in part]), np.array([p[1] for p in part], float)
        wanted = np.zeros((len(names), len(centres)), bool)
        np.put_along_axis(wanted, np.argsort(-(matrix @ centres.T), axis=1)[:, :probes], True, axis=1)
        needed = np.nonzero(wanted.any(0))[0].tolist()

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix, wanted=wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, cell = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                v = _matrix(batch.column(1), matrix.shape[1])
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for c in np.unique(cell):
                    mine, asking = np.nonzero(cell == c)[0], np.nonzero(wanted[:, c])[0]
                    for q, scores in zip(asking, matrix[asking] @ v[mine].T):
                        at = _best(ids[mine], scores, k)
                        found.append((np.full(len(at), names[q]), ids[mine[at]], scores[at]))
                columns = [np.concatenate(x) for x in zip(*found)] if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

        found = rows.where(F.col("cell").isin(needed)).select("id", "embedding", "cell").mapInArrow(run, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, id bigint, score double")
    return ranked(out, k)


#: At each place a pair of Chinese characters, or one that stands alone, or a whole word of Latin letters and digits.
TOKEN = r"(?=([\x{4e00}-\x{9fff}]{2}|(?<![\x{4e00}-\x{9fff}])[\x{4e00}-\x{9fff}](?![\x{4e00}-\x{9fff}])|(?<![a-z0-9])[a-z0-9]+))"


def tokens(c: Column) -> Column:
    """Words of Latin letters and digits, and pairs of Chinese characters (a single one by itself)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


#: Distinct terms of a query set up to which they are broadcast, so that one pass over the rows is enough.
TERMS = 1_000_000


def bm25_topk(rows: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, terms_at_once: int = TERMS) -> DataFrame:
    """(query_id, rank, id, score): Okapi BM25. rows: id, text; queries: query_id, query.

    One pass over the rows writes the words that are asked for and, as an empty word, every row with its length; only
    words that are asked for leave the map tasks. With more than `terms_at_once` terms their join shuffles, and
    the lengths take a pass of their own.
    """
    asked = materialize(queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")))
    terms = asked.select("term").distinct()
    sized = fence(rows.where("id is not null").select("id", tokens(F.col("text")).alias("words"))).select("id", F.size("words").alias("length"), "words")
    if terms.count() <= terms_at_once:
        wanted = F.broadcast(terms.unionByName(rows.sparkSession.createDataFrame([("",)], "term string")))
        words = materialize(sized.select("id", "length", F.explode(F.concat(F.array(F.lit("")), "words")).alias("term")).join(wanted, "term", "left_semi"))
        lengths, words = words.where("term = ''"), words.where("term <> ''")
    else:
        lengths, words = sized, sized.select("id", "length", F.explode("words").alias("term")).join(terms, "term", "left_semi")
    n, mean = lengths.agg(F.count(F.lit(1)).cast("double"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0))).first()
    postings = materialize(words.groupBy("term", "id", "length").agg(F.count("*").alias("tf")))
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    scores = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 4).alias("score"))
    return ranked(scores, k)


def fused(first: DataFrame, second: DataFrame, k: int = 10, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Weighted sum of two result lists, each scaled to [0, 1] per query; what a list lacks counts 0 there."""
    by = W.partitionBy("query_id")

    def scaled(df: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(by), F.max("score").over(by)
        return df.select("query_id", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)).alias(name))

    both = scaled(first, "a").join(scaled(second, "b"), ["query_id", "id"], "full_outer").fillna(0.0, ["a", "b"])
    return ranked(both.select("query_id", "id", F.round(weights[0] * F.col("a") + weights[1] * F.col("b"), 6).alias("score")), k)


#: Candidates up to which a join with the texts broadcasts them; beyond, it shuffles.
CANDIDATES = 200_000


def reranked(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Candidates ordered anew by the share of a query's terms they hold; ties by the first score."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("terms"))
    candidates = materialize(found.select("query_id", "id", F.col("score").alias("first_score")).join(asked, "query_id"))  # k rows a query
    both = rows.select("id", "text").join(small(candidates, CANDIDATES), "id")
    share = F.size(F.array_intersect("terms", tokens(F.col("text")))) / F.greatest(F.size("terms"), F.lit(1))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("first_score"), "id")
    scores = both.select("query_id", "id", "first_score", F.round(share, 6).alias("score"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (3, 5, 10), by: str = "question_type") -> DataFrame:
    """(by, k, queries, recall): the share of queries with a true result among the first k. found: query_id, rank, key; truth: query_id, key, by."""
    best = found.join(truth.select("query_id", "key"), ["query_id", "key"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = truth.select("query_id", by).distinct().join(best, "query_id", "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return asked.groupBy(by, "k").agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def evaluated(search: Callable[[DataFrame], DataFrame], queries: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (3, 5, 10), by: str = "question_type") -> DataFrame:
    """recall() of a search, with the mean seconds a query took: the search runs once over all queries. search: queries -> query_id, rank, key."""
    began = time.monotonic()
    found = materialize(search(queries))
    seconds = (time.monotonic() - began) / max(1, queries.count())
    return recall(found, truth, ks, by).withColumn("seconds_per_query", F.lit(seconds))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def answer_checks(answers: DataFrame, found: DataFrame, rows: DataFrame, least: float = 1.0) -> DataFrame:
    """(query_id, numbers, unsupported, supported, abstain): numbers of an answer that its evidence lacks; abstain if there is no evidence or its score is too low.

    answers: query_id, answer; found: query_id, rank, id, score; rows: id, text.
    """
    proof = found.join(rows.select("id", "text"), "id").groupBy("query_id").agg(F.max("score").alias("best"), F.array_distinct(F.flatten(F.collect_list(numbers(F.col("text"))))).alias("known"))  # k rows per query
    out = answers.select("query_id", numbers(F.col("answer")).alias("said")).join(proof, "query_id", "left")
    lacking = F.array_except("said", F.coalesce("known", F.array().cast("array<string>")))
    return out.select("query_id", F.size("said").alias("numbers"), F.size(lacking).alias("unsupported"), (F.size(lacking) == 0).alias("supported"), (F.coalesce("best", F.lit(0.0)) < least).alias("abstain"))


def citations(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Results with what a reader needs to look them up: (query_id, rank, doc_id, page). rows: id, doc_id, pages."""
    return found.join(rows.select("id", "doc_id", F.explode_outer("pages").alias("page")), "id").select("query_id", "rank", "doc_id", "page")


def citation_hit_rate(cited: DataFrame, truth: DataFrame) -> DataFrame:
    """The share of queries one of whose citations is true. truth: query_id, doc_id."""
    hits = truth.join(cited.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").agg(F.count("*").alias("queries"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)), 6).alias("hit_rate"))


def expanded(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Queries and their rewritings: each with a term replaced by a synonym. synonyms: term, synonym."""
    known = synonyms.where("term is not null and term <> '' and synonym is not null").distinct()
    words = queries.select("query_id", "query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    other = words.join(known, "term").select("query_id", F.replace(F.lower("query"), F.col("term"), F.col("synonym")).alias("query"))
    return queries.select("query_id", "query").unionByName(other).distinct()


def normalized(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, l2_normalize(F.col(column)))
