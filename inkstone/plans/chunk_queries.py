"""Queries and SQL of the text functions and of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import chunking as C
from inkstone.plans import sql as S
from inkstone.session import table


def pages(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "parsed_pages"), ["doc_id", "page"], "parsed_at")


def tables(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "structured_tables"), ["table_id"], "parsed_at")


def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("normalized"))


def text_clean_line(spark, d):
    return table(spark, d, "text_boxes").where("text is not null").select(X.clean_line(F.col("text")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def text_stable_id(spark, d):
    return table(spark, d, "doc_manifest").select("doc_id", X.stable_id(F.coalesce("title", F.lit(""))).alias("title_id"), X.stable_id(F.coalesce("file_path", F.lit(""))).alias("path_id")).distinct()


def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 240).alias("preview"))


def text_predicates(spark, d):
    c = F.col("text")
    flags = {"page_number": X.page_number_like(c), "disclaimer": X.disclaimer_like(c), "caption": X.caption_like(c), "numeric_or_period": X.numeric_or_period_like(c), "numeric": X.numeric_like(c)}
    return table(spark, d, "text_boxes").where("text is not null").select("box_id", *(v.alias(k) for k, v in flags.items())).distinct()


def split_windows(spark, d):
    return C.split_texts(table(spark, d, "documents"), "doc_id", "text", 512, 100)


def chunks_sections(spark, d):
    return C.section_chunks(pages(spark, d), 512, 100).select("chunk_id", "doc_id", "page", "section_id", "chunk_type", "text")


def chunks_fallback(spark, d):
    bare = pages(spark, d).withColumn("sections", F.filter("sections", lambda s: F.lit(False)))
    return C.fallback_chunks(bare, 512, 100).select("chunk_id", "doc_id", "page", "chunk_type", "text")


def chunks_tables(spark, d):
    return C.table_chunks(tables(spark, d), 512).select("chunk_id", "table_id", "part_index", "part_count", "row_start", "row_end", "row_count", "text")


def chunks_all(spark, d):
    return C.chunk_pages(pages(spark, d), tables(spark, d), 512, 100).select("chunk_id", "doc_id", "page", "chunk_type", "has_table", "text")


def _text(bbox):
    """An array of doubles as a text of whole hundredths, so that it compares everywhere."""
    return F.array_join(F.transform(bbox, lambda x: F.round(x * 100).cast("bigint").cast("string")), ",")


def chunks_record(spark, d):
    """The whole record of every chunk; arrays of structs by their sizes and ends."""
    r = C.chunk_records(pages(spark, d), tables(spark, d), 512, 100)
    flat = lambda what, *names: [F.col(f"{what}.{n}").alias(f"{what}_{n}") for n in names]
    return r.select(
        "chunk_id", "doc_id", "source", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "text", "chunk_type", "has_table", *flat("metadata", *C._fields(C.METADATA)),
        *flat("section", "section_id", "layout_type", "layoutno", "col_id"), _text(F.col("section.bbox")).alias("section_bbox"), F.array_join("section.box_ids", ",").alias("section_box_ids"),
        *flat("table", "table_id", "parent_table_id", "part_index", "part_count", "rows", "columns", "row_start", "row_end", "row_count", "caption", "source", "table_protection"), _text(F.col("table.bbox")).alias("table_bbox"),
        F.array_join(F.transform("table.cells", lambda c: F.concat_ws(",", c.row, c.col, c.text)), ";").alias("table_cells"), F.array_join(F.transform("table.protected_rows", lambda x: F.concat_ws(",", x.row, x.text)), ";").alias("table_protected_rows"),
    )


def chunk_sweep(spark, d):
    return C.sweep(pages(spark, d), tables(spark, d))


def chunk_stats(spark, d):
    chunks = C.latest(table(spark, d, "chunks"), ["chunk_id"], "text", wide=True)
    return C.chunk_stats(chunks.select("doc_id", "text", "chunk_type", "has_table", F.col("table_info.part_count").alias("part_count"), F.col("table_info.table_protection").alias("table_protection")))


def page_stats(spark, d):
    return C.page_stats(pages(spark, d), tables(spark, d))


def inspect_chunks(spark, d):
    chunks = C.latest(table(spark, d, "chunks"), ["chunk_id"], "text", wide=True)
    return C.inspect(chunks, keyword="营业收入", limit=10).select("chunk_id", "doc_id", "chunk_type", X.preview(F.col("text"), 240).alias("preview"))


def nonblank_chunks(spark, d):
    return C.latest(table(spark, d, "chunks"), ["chunk_id"], "text", wide=True).where(F.length(X.strip(F.col("text"))) > 0).select("chunk_id")


def _parts_sql(size: int) -> str:
    return f"""
rows0 AS (SELECT table_id, doc_id, page, {S.norm("coalesce(caption, '')")} AS caption, text, rows, protected_rows FROM {S.TABLES}),
lines AS (SELECT table_id, i, {S.norm("coalesce(protected_rows[i].text, '')")} AS t, protected_rows[i].row AS r, coalesce(protected_rows[i].is_header, false) AS head FROM rows0, LATERAL (SELECT unnest(generate_series(1, len(protected_rows))) AS i)),
pre AS (SELECT rows0.table_id, concat_ws(chr(10), nullif(caption, ''), (SELECT string_agg(t, chr(10) ORDER BY i) FROM lines l WHERE l.table_id = rows0.table_id AND head AND t <> '')) AS prefix,
  (SELECT count(*) FROM lines l WHERE l.table_id = rows0.table_id AND NOT head) AS data FROM rows0),
seq AS (SELECT table_id, t, r, row_number() OVER (PARTITION BY table_id ORDER BY i) AS k FROM lines WHERE NOT head AND t <> ''),
fold AS (
  SELECT seq.table_id, k, t, r, 1 AS part, length(prefix) + CASE WHEN prefix = '' THEN 0 ELSE 1 END + length(t) AS n, length(prefix) AS p FROM seq JOIN pre USING (table_id) WHERE k = 1
  UNION ALL
  SELECT s.table_id, s.k, s.t, s.r, f.part + CASE WHEN f.n + 1 + length(s.t) > {size} THEN 1 ELSE 0 END,
    CASE WHEN f.n + 1 + length(s.t) > {size} THEN p + CASE WHEN p = 0 THEN 0 ELSE 1 END + length(s.t) ELSE f.n + 1 + length(s.t) END, p
  FROM fold f JOIN seq s ON s.table_id = f.table_id AND s.k = f.k + 1
),
packed AS (SELECT table_id, part, concat_ws(chr(10), nullif(any_value(prefix), ''), string_agg(t, chr(10) ORDER BY k)) AS text, min(r) AS row_start, max(r) AS row_end, count(*) AS row_count FROM fold JOIN pre USING (table_id) GROUP BY table_id, part),
heads AS (SELECT pre.table_id, 1 AS part, prefix AS text, (SELECT min(r) FROM lines l WHERE l.table_id = pre.table_id AND head AND r >= 0) AS row_start, (SELECT max(r) FROM lines l WHERE l.table_id = pre.table_id AND head AND r >= 0) AS row_end,
  (SELECT count(*) FROM lines l WHERE l.table_id = pre.table_id AND head AND r >= 0) AS row_count FROM pre JOIN rows0 USING (table_id) WHERE data = 0 AND len(protected_rows) > 0 AND prefix <> ''),
blank AS (SELECT pre.table_id, 1 AS part, prefix AS text, NULL::INT AS row_start, NULL::INT AS row_end, 0 AS row_count FROM pre WHERE data > 0 AND prefix <> '' AND table_id NOT IN (SELECT table_id FROM seq)),
whole AS (SELECT table_id, 1 AS part, {S.norm("coalesce(text, '')")} AS text, NULL::INT AS row_start, NULL::INT AS row_end, coalesce(rows, 0) AS row_count FROM rows0 WHERE coalesce(len(protected_rows), 0) = 0),
parts AS (SELECT * FROM packed UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM blank UNION ALL SELECT * FROM whole WHERE text <> ''),
table_chunks AS (SELECT CASE WHEN c = 1 THEN table_id ELSE {S.number_id("table_id", "part", "part")} END AS chunk_id, table_id, part::INT AS part_index, c::INT AS part_count, row_start::INT AS row_start, row_end::INT AS row_end, row_count::INT AS row_count, text
  FROM (SELECT *, count(*) OVER (PARTITION BY table_id) AS c FROM parts))"""


def _sections_sql(size: int, overlap: int) -> str:
    return f"""
sec AS (SELECT doc_id, page, s.section_id, s.layout_type AS layout_type, {S.norm("coalesce(s.text, '')")} AS t FROM (SELECT doc_id, page, unnest(sections) AS s FROM {S.PAGES})),
section_chunks AS (SELECT {S.number_id("section_id", "c", "k")} AS chunk_id, doc_id, page, section_id, coalesce(nullif(layout_type, ''), 'text') AS chunk_type, w[k] AS text
  FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM (SELECT *, {S.windows("t", size, overlap)} AS w FROM sec))),
bare_pages AS (SELECT doc_id, page, {S.norm("coalesce(text, '')")} AS t FROM {S.PAGES}),
page_chunks AS (SELECT {S.number_id(S.number_id("doc_id", "p", "page"), "c", "k")} AS chunk_id, doc_id, page, 'text' AS chunk_type, w[k] AS text FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM (SELECT *, {S.windows("t", size, overlap)} AS w FROM bare_pages)))"""


def _all_sql(size: int, overlap: int) -> str:
    return f"""{_sections_sql(size, overlap)}, {_parts_sql(size)},
all_chunks AS (
  SELECT chunk_id, doc_id, page, chunk_type, false AS has_table, text, NULL::INT AS part_count, NULL::VARCHAR AS table_protection FROM section_chunks
  UNION ALL SELECT chunk_id, doc_id, page, chunk_type, false, text, NULL, NULL FROM page_chunks WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM section_chunks)
  UNION ALL SELECT c.chunk_id, t.doc_id, t.page, 'table', true, c.text, c.part_count, 'row_boundary' FROM table_chunks c JOIN {S.TABLES} t USING (table_id))"""


_STATS = """count(DISTINCT doc_id) AS doc_count, count(*) AS chunk_count, count_if(chunk_type = 'text')::BIGINT AS text_chunks, count_if(chunk_type = 'title')::BIGINT AS title_chunks, count_if(chunk_type = 'table')::BIGINT AS table_chunks, count_if(has_table)::BIGINT AS has_table_count,
  count_if(has_table AND coalesce(part_count, 1) > 1)::BIGINT AS split_table_chunks, count_if(has_table AND coalesce(table_protection, '') <> 'row_boundary')::BIGINT AS missing_protection, coalesce(round(avg(length(coalesce(text, ''))), 1), 0) AS avg_chars, coalesce(median(length(coalesce(text, ''))), 0)::DOUBLE AS median_chars, coalesce(max(length(coalesce(text, ''))), 0)::INT AS max_chars, round(count(*) / count(DISTINCT doc_id), 6) AS chunks_per_document"""


def _sweep_sql() -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_all_sql(a, b)} SELECT {a} AS chunk_size, {b} AS overlap, {_STATS} FROM all_chunks)" for a, b in C.CONFIGS)


def _record_sql() -> str:
    box = lambda c: f"array_to_string(list_transform({c}, lambda x: round(x * 100)::BIGINT::VARCHAR), ',')"
    meta = ", ".join(f"p.metadata.{n} AS metadata_{n}" for n in C._fields(C.METADATA))
    none = "NULL::VARCHAR AS table_table_id, NULL::VARCHAR AS table_parent_table_id, NULL::INT AS table_part_index, NULL::INT AS table_part_count, NULL::INT AS table_rows, NULL::INT AS table_columns, NULL::INT AS table_row_start, NULL::INT AS table_row_end, NULL::INT AS table_row_count, NULL::VARCHAR AS table_caption, NULL::VARCHAR AS table_source, NULL::VARCHAR AS table_table_protection, NULL::VARCHAR AS table_bbox, NULL::VARCHAR AS table_cells, NULL::VARCHAR AS table_protected_rows"
    page = f"p AS {S.PAGES}, s AS (SELECT doc_id, page, unnest(sections) AS s FROM p)"
    return f"""WITH RECURSIVE {_all_sql(512, 100)}, {page}
SELECT c.chunk_id, c.doc_id, p.source, c.page::VARCHAR AS pages, c.text, c.chunk_type, false AS has_table, {meta}, k.section_id AS section_section_id, s.s.layout_type AS section_layout_type, s.s.layoutno AS section_layoutno, s.s.col_id AS section_col_id, {box("s.s.bbox")} AS section_bbox, CASE WHEN s.s.section_id IS NOT NULL THEN array_to_string(s.s.box_ids, ',') END AS section_box_ids, {none}
  FROM all_chunks c JOIN p USING (doc_id, page) LEFT JOIN section_chunks k ON k.chunk_id = c.chunk_id LEFT JOIN s ON s.doc_id = k.doc_id AND s.page = k.page AND s.s.section_id = k.section_id WHERE NOT c.has_table
UNION ALL SELECT c.chunk_id, t.doc_id, p.source, t.page::VARCHAR, c.text, 'table', true, {meta}, NULL, NULL, NULL, NULL, NULL, NULL, t.table_id, t.table_id, c.part_index, c.part_count, t.rows, t.columns, c.row_start, c.row_end, c.row_count, coalesce(t.caption, ''), t.source, 'row_boundary', {box("t.bbox")},
  array_to_string(list_transform(t.cells, lambda x: concat_ws(',', x.row, x.col, x.text)), ';'), array_to_string(list_transform(t.protected_rows, lambda x: concat_ws(',', x.row, x.text)), ';') FROM table_chunks c JOIN {S.TABLES} t USING (table_id) LEFT JOIN p ON p.doc_id = t.doc_id AND p.page = t.page"""


_B = S.bare("text")
_N = S.strip("translate(text, ',%％', '')")
_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY text DESC) = 1)"
_DIGITS = r"\p{Nd}"


def _preview_sql(c: str) -> str:
    n = f"replace({S.norm(c)}, chr(10), ' ')"
    return f"CASE WHEN length({n}) <= 240 THEN {n} ELSE substring({n}, 1, 237) || '...' END"


def _id_sql(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({S.strip(c)}), '\\.[a-z0-9]+$', ''), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'document')"


QUERIES = {f.__name__: f for f in (text_normalize, text_clean_line, text_stable_id, text_preview, text_predicates, split_windows, chunks_sections, chunks_fallback, chunks_tables, chunks_all, chunks_record, chunk_sweep, chunk_stats, page_stats, inspect_chunks, nonblank_chunks)}
SQL = {
    "text_normalize": lambda: f"SELECT doc_id, {S.norm('text')} AS normalized FROM documents",
    "text_clean_line": lambda: f"SELECT {S.strip('replace(' + S.norm('text') + ', chr(10), chr(32))')} AS line, count(*) AS n FROM text_boxes WHERE text IS NOT NULL GROUP BY 1",
    "text_stable_id": lambda: f"""SELECT DISTINCT doc_id, {_id_sql("coalesce(title, '')")} AS title_id, {_id_sql("coalesce(file_path, '')")} AS path_id FROM doc_manifest""",
    "text_preview": lambda: f"SELECT doc_id, {_preview_sql('text')} AS preview FROM documents",
    "text_predicates": lambda: f"""SELECT DISTINCT box_id, regexp_matches({_B}, '^({_DIGITS}+[/／]{_DIGITS}+|第?{_DIGITS}+页共?{_DIGITS}*页?|-?{_DIGITS}+-)$') AS page_number, regexp_matches({_B}, '请务必阅读.*免责|免责声明|本报告仅供') AS disclaimer, regexp_matches({_B}, '^(表|图表|图|资料来源|数据来源|来源)') AS caption,
      regexp_matches({_N}, '^(-|—|--|－|\\(?[-+]?{_DIGITS}+(\\.{_DIGITS}+)?\\)?|{_DIGITS}{{4}}[A-Z]?)$') AS numeric_or_period, length({_N}) > 0 AND length(regexp_replace({_N}, '[^{_DIGITS}.\\-+()/]', '', 'g')) / greatest(length({_N}), 1) >= 0.65 AS numeric FROM text_boxes WHERE text IS NOT NULL""",
    "split_windows": lambda: f"SELECT doc_id, k::INT AS piece, w[k] AS text FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM (SELECT doc_id, {S.windows('t', 512, 100)} AS w FROM (SELECT doc_id, {S.norm('text')} AS t FROM documents)))",
    "chunks_sections": lambda: f"WITH {_sections_sql(512, 100)} SELECT chunk_id, doc_id, page, section_id, chunk_type, text FROM section_chunks",
    "chunks_fallback": lambda: f"WITH {_sections_sql(512, 100)} SELECT * FROM page_chunks",
    "chunks_tables": lambda: f"WITH RECURSIVE {_parts_sql(512)} SELECT * FROM table_chunks",
    "chunks_all": lambda: f"WITH RECURSIVE {_all_sql(512, 100)} SELECT chunk_id, doc_id, page, chunk_type, has_table, text FROM all_chunks",
    "chunks_record": _record_sql,
    "chunk_sweep": _sweep_sql,
    "chunk_stats": lambda: f"SELECT {_STATS} FROM (SELECT *, table_info.part_count AS part_count, table_info.table_protection AS table_protection FROM {_CHUNKS})",
    "page_stats": lambda: f"""WITH p AS {S.PAGES}, t AS {S.TABLES} SELECT 'pages' AS what, 'all' AS name, count(*) AS n FROM p UNION ALL SELECT 'documents', 'all', count(DISTINCT doc_id) FROM p UNION ALL SELECT 'pages by industry', coalesce(nullif(metadata.industry, ''), '未标注'), count(*) FROM p GROUP BY 2
      UNION ALL SELECT 'tables', 'all', count(*) FROM t UNION ALL SELECT 'tables by source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM t GROUP BY 2""",
    "inspect_chunks": lambda: f"SELECT chunk_id, doc_id, chunk_type, {_preview_sql('text')} AS preview FROM {_CHUNKS} WHERE contains(text, '营业收入') ORDER BY doc_id, chunk_id LIMIT 10",
    "nonblank_chunks": lambda: f"SELECT chunk_id FROM {_CHUNKS} WHERE length({S.strip('text')}) > 0",
}
