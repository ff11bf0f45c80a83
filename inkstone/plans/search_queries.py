"""Queries and SQL of the catalogue, of retrieval and of streaming. Query sets are the rows whose id is divisible by 20."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkstone.functions.text import preview
from inkstone.operators import catalog as K
from inkstone.operators import chunking as C
from inkstone.operators import retrieval as R
from inkstone.plans import sql as S
from inkstone.session import own_dir, table
from inkstone.streaming import pages as P


ROOT, RAW = "/srv/corpus", "data/raw"


def _records(spark, d):
    return K.manifest_records(table(spark, d, "doc_manifest"), ROOT)


def _found(spark, d):
    """The documents that have pages stand in for the files on disk; each page counts 1,000 bytes."""
    files = table(spark, d, "parsed_pages").groupBy(F.concat(F.lit(f"{ROOT}/"), F.col("source")).alias("path")).agg((F.countDistinct("page") * 1000).alias("length"))
    return K.discovered_records(files, RAW, ROOT)


def manifest_records(spark, d):
    return _records(spark, d)


def manifest_discovered(spark, d):
    return _found(spark, d).select("doc_id", "file_path", "title", "industry", "doc_type", "file_size_bytes", "resolved")


def manifest_documents(spark, d):
    """All listed records whose file exists, and the files that are not listed."""
    return K.documents(_records(spark, d), _found(spark, d)).select("doc_id", "file_path", "title", "industry", "doc_type")


def manifest_metadata(spark, d):
    return K.metadata(_records(spark, d)).select("doc_id", "source", "metadata.*")


def manifest_missing(spark, d):
    return K.missing(_records(spark, d), _found(spark, d)).select("doc_id", "file_path")


def manifest_duplicates(spark, d):
    return K.duplicates(_records(spark, d))


def manifest_by_group(spark, d):
    return K.by_group(_records(spark, d), _found(spark, d))


def manifest_validation(spark, d):
    return K.validation(_records(spark, d), _found(spark, d))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding", "label")


def vector_normalize(spark, d):
    return R.normalized(_vectors(spark, d).withColumn("embedding", F.transform("embedding", lambda x: x * 2))).select("id", F.posexplode("embedding").alias("k", "v")).groupBy("id").agg(F.round(F.sum(F.col("v") * F.col("v")), 6).alias("length"), F.round(F.max("v"), 6).alias("largest"))


def vector_topk(spark, d):
    return R.vector_topk(_vectors(spark, d), _vector_queries(spark, d), 5).withColumn("score", F.round("score", 6))


def vector_label_recall(spark, d):
    """How often the 5 nearest other vectors have the label of the vector asked for."""
    found = R.vector_topk(_vectors(spark, d), _vector_queries(spark, d), 6).where("id <> query_id")
    order = R.W.partitionBy("query_id").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(order)).where("rank <= 5").join(_vectors(spark, d).select("id", "label"), "id")
    return found.join(_vector_queries(spark, d).select("query_id", F.col("label").alias("asked")), "query_id").groupBy("asked").agg(F.count("*").alias("results"), F.round(F.avg((F.col("label") == F.col("asked")).cast("double")), 6).alias("same_label"))


def ivf_topk(spark, d):
    """The nearest vectors by an index stored by cell, of which each query reads its nearest cells."""
    path = f"{own_dir(spark)}/ivf-{uuid.uuid4().hex}"
    R.save_ivf(_vectors(spark, d), path)
    return R.ivf_topk(spark, path, _vector_queries(spark, d), 5).withColumn("score", F.round("score", 6))


def ivf_recall(spark, d):
    """The share of the exact results that the clustered search finds."""
    exact = R.vector_topk(_vectors(spark, d), _vector_queries(spark, d), 5).select("query_id", "id")
    got = ivf_topk(spark, d).select("query_id", "id").withColumn("hit", F.lit(1.0))
    return exact.join(got, ["query_id", "id"], "left").agg(F.count("*").alias("results"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _chunks(spark, d):
    return C.latest(table(spark, d, "chunks"), ["chunk_id"], "text", wide=True).select(F.col("chunk_id").alias("id"), "text", "doc_id", "pages")


def _questions(spark, d):
    return table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "query", "answer", "question_type", "ground_truth_doc_id")


def bm25_topk(spark, d):
    return R.bm25_topk(_documents(spark, d), _questions(spark, d), 10)


def rerank_topk(spark, d):
    return R.reranked(R.bm25_topk(_documents(spark, d), _questions(spark, d), 20), _documents(spark, d), _questions(spark, d), 5)


def dense_topk(spark, d):
    """Nearest documents by the built-in encoder."""
    rows = R.encoded(_documents(spark, d).where(F.length("text") > 0), "text")
    return R.vector_topk(rows, R.encoded(_questions(spark, d).select("query_id", "query"), "query", queries=True), 10).withColumn("score", F.round("score", 5))


def hybrid_topk(spark, d):
    """Both lists, weighted 0.6 (vectors) and 0.4 (words)."""
    return R.fused(dense_topk(spark, d), bm25_topk(spark, d))


def fused_topk(spark, d):
    """Fusion by itself: word search over documents at two settings."""
    other = R.bm25_topk(_documents(spark, d), _questions(spark, d), 10, k1=2.0, b=0.25)
    return R.fused(bm25_topk(spark, d), other)


def chunk_search(spark, d):
    """Results over chunks as a reader sees them: rank, place and the start of the text."""
    found = R.bm25_topk(_chunks(spark, d), _questions(spark, d), 5)
    return found.join(_chunks(spark, d), "id").select("query_id", "rank", F.col("id").alias("chunk_id"), "doc_id", "score", preview(F.col("text"), 240).alias("preview"))


def retrieval_recall(spark, d):
    found = R.bm25_topk(_chunks(spark, d), _questions(spark, d), 10).join(_chunks(spark, d).select("id", F.col("doc_id").alias("key")), "id")
    truth = _questions(spark, d).where("ground_truth_doc_id is not null").select("query_id", F.col("ground_truth_doc_id").alias("key"), "question_type")
    return R.recall(found, truth)


def retrieval_citations(spark, d):
    return R.citations(R.bm25_topk(_chunks(spark, d), _questions(spark, d), 5), _chunks(spark, d))


def citation_hit_rate(spark, d):
    truth = _questions(spark, d).where("ground_truth_doc_id is not null").select("query_id", F.col("ground_truth_doc_id").alias("doc_id"))
    return R.citation_hit_rate(retrieval_citations(spark, d), truth)


def answer_checks(spark, d):
    return R.answer_checks(_questions(spark, d), R.bm25_topk(_documents(spark, d), _questions(spark, d), 5), _documents(spark, d), 20.0)


def query_expansion(spark, d):
    words = spark.createDataFrame([("储能", "蓄能"), ("轮胎", "车胎"), ("ledger", "register")], "term string, synonym string")
    return R.expanded(table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query"), words)


def stream_chunks(spark, d):
    """All deliveries of all pages, chunked as a stream."""
    return P.chunked_once(spark, f"{d}/parsed_pages.parquet", f"stream-{uuid.uuid4().hex}")


_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_ID = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\.[a-z0-9]+$', ''), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'document')"
_T = lambda c: S.strip(f"coalesce({c}::VARCHAR, '')")
_RECORDS = f"""r AS (SELECT coalesce(nullif({_T("doc_id")}, ''), {_ID.format(_STEM.format(_T("file_path")))}) AS doc_id, {_T("file_path")} AS file_path, {", ".join(f"{_T(c)} AS {c}" for c in K.FIELDS)},
  CASE WHEN regexp_matches({_T("pages")}, '^[+-]?\\d+$') THEN try_cast({_T("pages")} AS INTEGER) END AS expected_pages, try_cast({_T("file_size_bytes")} AS BIGINT) AS file_size_bytes, CASE WHEN starts_with({_T("file_path")}, '/') THEN {_T("file_path")} ELSE '{ROOT}/' || {_T("file_path")} END AS resolved FROM doc_manifest WHERE length({_T("file_path")}) > 0),
f AS (SELECT source AS file_path, '{ROOT}/' || source AS resolved, count(DISTINCT page) * 1000 AS length FROM parsed_pages GROUP BY 1),
disc AS (SELECT {_ID.format(_STEM.format("file_path"))} AS doc_id, file_path, {_STEM.format("file_path")} AS title, CASE WHEN contains(replace(file_path, 'data/raw/', ''), '/') THEN split_part(replace(file_path, 'data/raw/', ''), '/', 1) ELSE '' END AS industry, 'pdf' AS doc_type, length AS file_size_bytes, resolved FROM f)"""
_GROUP = lambda c: f"SELECT '{c}' AS grouping, coalesce(nullif({c}, ''), '(empty)') AS name, count(*) AS files, coalesce(sum(expected_pages), 0)::BIGINT AS pages, coalesce(sum(f.length), 0)::BIGINT AS bytes, count_if(expected_pages IS NULL)::BIGINT AS no_pages FROM r LEFT JOIN f USING (resolved) GROUP BY 2"
_TOP = "SELECT q.vec_id AS query_id, (row_number() OVER w)::INT AS rank, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, q.label AS asked, v.label AS label FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {0} WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id)"


def _tok(c: str) -> str:
    c = f"lower(coalesce({c}, ''))"
    return f"list_concat(regexp_extract_all({c}, '[a-z0-9]+'), flatten(list_transform(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(generate_series(1, length(r) - 1), lambda k: substring(r, k, 2)) END)))"


def _bm25(rows: str, k: int, name: str = "", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs that end in best{name}: query_id, rank, id, score."""
    n = name
    return f"""q{n} AS (SELECT item_id AS query_id, query, answer, question_type, ground_truth_doc_id FROM eval_items WHERE item_id % 20 = 0), asked{n} AS (SELECT query_id, unnest(list_distinct({_tok("query")})) AS term FROM q{n}),
d{n} AS (SELECT id, {_tok("text")} AS words FROM ({rows})), tot{n} AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM d{n}),
post{n} AS (SELECT term, id, count(*) AS tf, any_value(length) AS length FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM d{n}) WHERE term IN (SELECT term FROM asked{n}) GROUP BY 1, 2),
dfs{n} AS (SELECT term, count(*) AS df FROM post{n} GROUP BY 1),
sc{n} AS (SELECT query_id, id, round(sum(ln(1 + (tot{n}.n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * length / mean))), 4) AS score FROM post{n} JOIN dfs{n} USING (term) JOIN asked{n} USING (term), tot{n} GROUP BY 1, 2),
best{n} AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank, id, score FROM sc{n} QUALIFY rank <= {k})"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_CH = "(SELECT chunk_id AS id, text, doc_id, pages FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY text DESC) = 1)"
_CHROWS = f"SELECT id, text FROM {_CH}"
_NUMS = lambda c: f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '\\d+(?:,\\d{{3}})*(?:\\.\\d+)?'), lambda n: replace(n, ',', '')))"
_SCALED = lambda t, n: f"(SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS {n} FROM {t} WINDOW w AS (PARTITION BY query_id))"


def _preview_sql(c: str) -> str:
    n = f"replace({S.norm(c)}, chr(10), ' ')"
    return f"CASE WHEN length({n}) <= 240 THEN {n} ELSE substring({n}, 1, 237) || '...' END"


def _stream_sql() -> str:
    sec = f"SELECT doc_id, page, s.section_id, s.layout_type AS layout_type, {S.norm(chr(99) + 'oalesce(s.text, $$$$)')} AS t FROM (SELECT doc_id, page, unnest(sections) AS s FROM parsed_pages)"
    return f"""SELECT {S.number_id("section_id", "c", "k")} AS chunk_id, doc_id, page, coalesce(nullif(layout_type, ''), 'text') AS chunk_type, w[k] AS text FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM (SELECT *, {S.windows("t", 512, 100)} AS w FROM ({sec})))
      UNION ALL SELECT {S.number_id(S.number_id("doc_id", "p", "page"), "c", "k")}, doc_id, page, 'text', w[k] FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM (SELECT *, {S.windows("t", 512, 100)} AS w FROM (SELECT doc_id, page, {S.norm("coalesce(text, '')")} AS t FROM parsed_pages WHERE len(list_filter(sections, lambda s: length({S.norm("coalesce(s.text, '')")}) > 0)) = 0)))"""


QUERIES = {f.__name__: f for f in (
    manifest_records, manifest_discovered, manifest_documents, manifest_metadata, manifest_missing, manifest_duplicates, manifest_by_group, manifest_validation, vector_normalize, vector_topk, vector_label_recall, ivf_topk, ivf_recall,
    bm25_topk, rerank_topk, dense_topk, hybrid_topk, fused_topk, chunk_search, retrieval_recall, retrieval_citations, citation_hit_rate, answer_checks, query_expansion, stream_chunks,
)}
SQL = {
    "manifest_records": lambda: f"WITH {_RECORDS} SELECT * FROM r",
    "manifest_discovered": lambda: f"WITH {_RECORDS} SELECT * FROM disc",
    "manifest_documents": lambda: f"WITH {_RECORDS} SELECT doc_id, file_path, title, industry, doc_type FROM r SEMI JOIN f USING (resolved) UNION ALL SELECT doc_id, file_path, title, industry, doc_type FROM disc ANTI JOIN r USING (resolved)",
    "manifest_metadata": lambda: f"WITH {_RECORDS} SELECT doc_id, file_path AS source, title, industry, doc_type, year_month, source_url, expected_pages, file_size_bytes, notes FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY file_path) = 1",
    "manifest_missing": lambda: f"WITH {_RECORDS} SELECT doc_id, file_path FROM r ANTI JOIN f USING (resolved)",
    "manifest_duplicates": lambda: f"WITH {_RECORDS} SELECT 'doc_id' AS kind, doc_id AS value, count(*) AS n FROM r GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'file_path', resolved, count(*) FROM r GROUP BY 2 HAVING count(*) > 1",
    "manifest_by_group": lambda: f"WITH {_RECORDS} {_GROUP('industry')} UNION ALL {_GROUP('doc_type')}",
    "manifest_validation": lambda: f"""WITH {_RECORDS}, x AS (SELECT (SELECT count(*) FROM r) AS manifest_records, (SELECT count(*) FROM f) AS raw_files, (SELECT count(*) FROM (SELECT doc_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS duplicate_doc_ids, (SELECT count(*) FROM (SELECT resolved FROM r GROUP BY 1 HAVING count(*) > 1)) AS duplicate_paths,
      (SELECT count(*) FROM r ANTI JOIN f USING (resolved)) AS missing_paths, (SELECT count(*) FROM f ANTI JOIN r USING (resolved)) AS unlisted_files) SELECT *, CASE WHEN duplicate_doc_ids + duplicate_paths + missing_paths + unlisted_files > 0 THEN 'FAIL' ELSE 'OK' END AS status FROM x""",
    "vector_normalize": lambda: "SELECT vec_id AS id, round(1.0::DOUBLE, 6) AS length, round(list_max(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS largest FROM embeddings",
    "vector_topk": lambda: f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_TOP.format('')}) WHERE rank <= 5",
    "vector_label_recall": lambda: f"SELECT asked, count(*) AS results, round(avg(CASE WHEN label = asked THEN 1.0::DOUBLE ELSE 0 END), 6) AS same_label FROM ({_TOP.format('AND q.vec_id <> v.vec_id')}) WHERE rank <= 5 GROUP BY 1",
    "bm25_topk": lambda: f"WITH {_bm25(_DOCS, 10)} SELECT * FROM best",
    "rerank_topk": lambda: f"""WITH {_bm25(_DOCS, 20)}, s AS (SELECT best.query_id, best.id, best.score AS first_score, round(len(list_intersect(list_distinct({_tok("q.query")}), d.words)) / greatest(len(list_distinct({_tok("q.query")})), 1), 6) AS score FROM best JOIN q USING (query_id) JOIN d USING (id))
      SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_score DESC, id))::INT AS rank, id, score FROM s QUALIFY rank <= 5""",
    "fused_topk": lambda: f"""WITH {_bm25(_DOCS, 10)}, {_bm25(_DOCS, 10, "2", 2.0, 0.25)}, z AS (SELECT query_id, id, round(0.6::DOUBLE * coalesce(a, 0) + 0.4::DOUBLE * coalesce(b, 0), 6) AS score FROM {_SCALED("best", "a")} FULL JOIN {_SCALED("best2", "b")} USING (query_id, id))
      SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank, id, score FROM z QUALIFY rank <= 10""",
    "chunk_search": lambda: f"WITH {_bm25(_CHROWS, 5)} SELECT query_id, rank, id AS chunk_id, doc_id, score, {_preview_sql('text')} AS preview FROM best JOIN {_CH} USING (id)",
    "retrieval_recall": lambda: f"""WITH {_bm25(_CHROWS, 10)}, h AS (SELECT q.query_id, question_type, min(rank) FILTER (WHERE c.doc_id = ground_truth_doc_id) AS first FROM q LEFT JOIN best USING (query_id) LEFT JOIN {_CH} c ON c.id = best.id WHERE ground_truth_doc_id IS NOT NULL GROUP BY 1, 2)
      SELECT question_type, k::INT AS k, count(*) AS queries, round(avg(CASE WHEN first <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM h, (SELECT unnest([3, 5, 10]) AS k) GROUP BY 1, 2""",
    "retrieval_citations": lambda: f"WITH {_bm25(_CHROWS, 5)} SELECT query_id, rank, doc_id, unnest(pages) AS page FROM best JOIN {_CH} USING (id)",
    "citation_hit_rate": lambda: f"WITH {_bm25(_CHROWS, 5)}, h AS (SELECT q.query_id, bool_or(coalesce(c.doc_id = ground_truth_doc_id, false)) AS hit FROM q LEFT JOIN best USING (query_id) LEFT JOIN {_CH} c ON c.id = best.id WHERE ground_truth_doc_id IS NOT NULL GROUP BY 1) SELECT count(*) AS queries, round(avg(hit::INT::DOUBLE), 6) AS hit_rate FROM h",
    "answer_checks": lambda: f"""WITH {_bm25(_DOCS, 5)}, p AS (SELECT query_id, max(score) AS top, list_distinct(flatten(list({_NUMS("documents.text")}))) AS known FROM best JOIN documents ON documents.doc_id = best.id GROUP BY 1), a AS (SELECT query_id, {_NUMS("answer")} AS said FROM q),
      u AS (SELECT a.query_id, len(said)::INT AS numbers, len(list_filter(said, lambda n: NOT list_contains(coalesce(known, []), n)))::INT AS unsupported, top FROM a LEFT JOIN p USING (query_id)) SELECT query_id, numbers, unsupported, unsupported = 0 AS supported, coalesce(top, 0) < 20 AS abstain FROM u""",
    "query_expansion": lambda: f"""WITH q AS (SELECT item_id AS query_id, query FROM eval_items), s(term, synonym) AS (VALUES ('储能', '蓄能'), ('轮胎', '车胎'), ('ledger', 'register')), w AS (SELECT query_id, query, unnest(list_distinct({_tok("query")})) AS term FROM q)
      SELECT query_id, query FROM q UNION SELECT query_id, replace(lower(query), term, synonym) FROM w JOIN s USING (term)""",
    "stream_chunks": _stream_sql,
}
