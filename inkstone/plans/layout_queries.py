"""Queries and SQL of layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import catalog as K
from inkstone.operators import layout as L
from inkstone.plans import sql as S
from inkstone.plans.table_queries import _boxes, _tables
from inkstone.session import table


def _tags(spark, d):
    return L.tagged(_boxes(spark, d), _tables(spark, d))


def layout_repeated_margins(spark, d):
    return L.repeated_margins(_boxes(spark, d))


def layout_tags(spark, d):
    return _tags(spark, d).select("box_id", "layout_type", "layoutno")


def layout_regions(spark, d):
    return L.regions(_tags(spark, d), _tables(spark, d))


def layout_columns(spark, d):
    return L.with_columns(_tags(spark, d)).select("box_id", "col_id")


def layout_captions(spark, d):
    return L.attached_captions(_tags(spark, d), _tables(spark, d))


def layout_sections(spark, d):
    out = L.sections(L.with_columns(_tags(spark, d)))
    corner = lambda k, n: F.col("bbox")[k].alias(n)
    return out.select("section_id", "doc_id", "page", "text", "layout_type", "layoutno", "col_id", corner(0, "x0"), corner(1, "top"), corner(2, "x1"), corner(3, "bottom"), F.array_join("box_ids", ",").alias("box_ids"))


def layout_pages(spark, d):
    return L.assembled(_boxes(spark, d), _tables(spark, d)).select("doc_id", "page", "text", F.coalesce(F.size("sections"), F.lit(0)).alias("section_count"), "text_box_count", "layout_region_count", "table_count")


def pages_record(spark, d):
    """The whole record of every page with boxes; arrays of structs by their ids and what was found for them."""
    documents = K.metadata(K.manifest_records(table(spark, d, "doc_manifest")))
    r = L.page_records(_boxes(spark, d), _tables(spark, d), documents)
    ids = lambda c, f: F.array_join(F.transform(c, f), " ").alias(c)
    return r.select(
        "doc_id", "source", "page", "text", ids("sections", lambda s: F.concat_ws(",", s.section_id, s.layout_type, s.col_id)), ids("tables", lambda t: F.concat_ws(",", t.table_id, t.caption)), ids("layout_regions", lambda a: F.concat_ws(",", a.region_id, a.type)),
        ids("text_boxes", lambda b: F.concat_ws(",", b.box_id, b.layout_type, b.layoutno, b.col_id)), "metadata.title", "metadata.expected_pages", "parser.text_box_count", "parser.layout_region_count", "parser.table_count", F.col("parser.name").alias("parser_name"),
    )


def layout_rows(spark, d):
    return L.box_rows(_boxes(spark, d), _tables(spark, d)).select("box_id", "row")


def _shown(found):
    cells = F.array_join(F.transform("cells", lambda c: F.concat(c.row.cast("string"), F.lit(","), c.col.cast("string"), F.lit(","), c.text_box_ids[0])), " ")
    return found.select("table_id", "doc_id", "page", "caption", *(F.col("bbox")[k].alias(n) for k, n in enumerate(("x0", "top", "x1", "bottom"))), cells.alias("cells"))


def layout_detected_tables(spark, d):
    """Tables without lines beside those already known."""
    return _shown(L.detected_tables(_boxes(spark, d), _tables(spark, d)))


def layout_redetected_tables(spark, d):
    """The cells of every table, and its caption above them, taken for text boxes on a page of its own without known tables."""
    known = _tables(spark, d).withColumn("doc_id", F.col("table_id"))
    cell = known.select("table_id", "doc_id", "page", F.posexplode("cells").alias("ord", "c")).where("size(c.bbox) = 4")
    cells = cell.select("doc_id", "page", F.col("ord").alias("box_ord"), F.concat("table_id", F.lit("-r"), F.col("c.row").cast("string"), F.lit("c"), F.col("c.col").cast("string")).alias("box_id"), "c.text", *(F.col("c.bbox")[k].alias(n) for k, n in enumerate(("x0", "top", "x1", "bottom"))))
    above = known.where("size(bbox) = 4 and caption is not null").select("doc_id", "page", F.lit(-1).alias("box_ord"), F.concat("table_id", F.lit("-caption")).alias("box_id"), F.col("caption").alias("text"), F.col("bbox")[0].alias("x0"), (F.col("bbox")[1] - 20).alias("top"), F.col("bbox")[2].alias("x1"), (F.col("bbox")[1] - 8).alias("bottom"))
    return _shown(L.detected_tables(cells.unionByName(above), known.limit(0)))


_N, _B = S.norm("coalesce(b.text, '')"), S.bare("coalesce(b.text, '')")
_D = r"\p{Nd}"
_NUM = f"regexp_matches({_B}, '^({_D}+[/／]{_D}+|第?{_D}+页共?{_D}*页?|-?{_D}+-)$') OR regexp_matches({_B}, '请务必阅读.*免责|免责声明|本报告仅供')"
_OVER = "greatest(0, b.x1 - b.x0) * greatest(0, b.bottom - b.top) > 0 AND len(t.bbox) = 4 AND greatest(0, least(b.x1, t.bbox[3]) - greatest(b.x0, t.bbox[1])) * greatest(0, least(b.bottom, t.bbox[4]) - greatest(b.top, t.bbox[2])) / (greatest(0, b.x1 - b.x0) * greatest(0, b.bottom - b.top)) >= 0.45"
_BASE = f"""b0 AS {S.BOXES},
np AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b0 GROUP BY 1 HAVING count(DISTINCT page) >= 3),
rep AS (SELECT doc_id, text FROM (SELECT doc_id, text, count(DISTINCT page) AS n FROM b0 WHERE page_height > 0 AND text <> '' AND (top <= page_height * 0.10 OR bottom >= page_height * 0.90) AND length(text) BETWEEN 3 AND 100 GROUP BY 1, 2) JOIN np USING (doc_id) WHERE n >= greatest(2, floor(pages * 0.35::DOUBLE))),
fonts AS (SELECT doc_id, page, median(font_size) AS mf FROM b0 WHERE font_size > 0 GROUP BY 1, 2),
tabs AS (SELECT table_id, doc_id, page, coalesce(caption, '') AS caption, bbox, row_number() OVER (PARTITION BY doc_id, page ORDER BY contains(table_id, '-layout-'), table_id) AS ord FROM {S.TABLES}),
hits AS (SELECT b.box_id, min(t.ord) AS ord FROM b0 b JOIN tabs t ON t.doc_id = b.doc_id AND t.page = b.page WHERE (t.caption <> '' AND {S.norm("t.caption")} = {_N}) OR ({_OVER}) GROUP BY 1),
x AS (SELECT b.*, mf, rep.text IS NOT NULL AS again, h.ord, t.ord IS NOT NULL AND t.caption <> '' AND {S.norm("t.caption")} = {_N} AS captioned, page_height > 0 AND (bottom >= page_height * 0.82 OR top <= page_height * 0.12) AND ({_NUM}) AS margin, regexp_matches({_B}, '^(表|图表|图|资料来源|数据来源|来源)') AS cap
  FROM b0 b LEFT JOIN rep ON rep.doc_id = b.doc_id AND rep.text = b.text LEFT JOIN fonts f ON f.doc_id = b.doc_id AND f.page = b.page LEFT JOIN hits h ON h.box_id = b.box_id LEFT JOIN tabs t ON t.doc_id = b.doc_id AND t.page = b.page AND t.ord = h.ord),
y AS (SELECT *, CASE WHEN margin AND bottom >= page_height * 0.5 THEN 'footer' WHEN margin THEN 'header' WHEN again AND page_height > 0 AND top <= page_height * 0.15 THEN 'header' WHEN again AND page_height > 0 AND bottom >= page_height * 0.85 THEN 'footer' WHEN captioned THEN 'table caption' WHEN ord IS NOT NULL THEN 'table' WHEN cap THEN 'table caption'
  WHEN mf > 0 AND coalesce(font_size, 0) >= mf * 1.18 AND page_height > 0 AND top <= page_height * 0.28 AND length(coalesce(text, '')) <= 80 THEN 'title' ELSE 'text' END AS layout_type FROM x),
tag AS (SELECT *, CASE layout_type WHEN 'footer' THEN 'footer-0' WHEN 'header' THEN 'header-0' WHEN 'table' THEN 'table-' || ord WHEN 'title' THEN 'title-0' WHEN 'text' THEN 'text-0' ELSE CASE WHEN captioned THEN 'table-' || ord || '-caption' ELSE 'table-caption' END END AS layoutno FROM y),
cand AS (SELECT doc_id, page, x0, page_width AS w FROM tag WHERE layout_type IN ('title', 'text') AND x1 > x0 AND bottom > top AND page_width > 0),
an0 AS (SELECT doc_id, page, min(x0) AS a0, max(w) AS w FROM cand GROUP BY 1, 2 HAVING count(*) >= 8),
an1 AS (SELECT an0.*, (SELECT min(c.x0) FROM cand c WHERE c.doc_id = an0.doc_id AND c.page = an0.page AND c.x0 - a0 > an0.w * 0.22::DOUBLE) AS a1 FROM an0),
an2 AS (SELECT an1.*, (SELECT min(c.x0) FROM cand c WHERE c.doc_id = an1.doc_id AND c.page = an1.page AND c.x0 - a1 > an1.w * 0.22::DOUBLE) AS a2 FROM an1),
cols AS (SELECT tag.*, CASE WHEN a0 IS NULL THEN 0 WHEN abs(x0 - a0) <= coalesce(abs(x0 - a1), 1e300) AND abs(x0 - a0) <= coalesce(abs(x0 - a2), 1e300) THEN 0 WHEN abs(x0 - a1) <= coalesce(abs(x0 - a2), 1e300) THEN 1 ELSE 2 END::INT AS col_id FROM tag LEFT JOIN an2 ON an2.doc_id = tag.doc_id AND an2.page = tag.page),
flow AS (SELECT * FROM cols WHERE layout_type NOT IN ('header', 'footer', 'table', 'table caption') AND coalesce(text, '') <> ''),
steps AS (SELECT *, row_number() OVER o AS rn, CASE WHEN lag(col_id) OVER o IS NULL OR lag(col_id) OVER o <> col_id OR lag(layout_type) OVER o <> layout_type OR lag(layoutno) OVER o <> layoutno OR top - lag(bottom) OVER o > greatest(18, lag(coalesce(font_size, 0)) OVER o * 2.2) THEN 1 ELSE 0 END AS new FROM flow WINDOW o AS (PARTITION BY doc_id, page ORDER BY col_id, top, x0, box_ord, box_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY rn) AS run FROM steps),
sec0 AS (SELECT doc_id, page, run, {S.norm("string_agg(text, chr(10) ORDER BY rn)")} AS text, any_value(layout_type) AS layout_type, any_value(layoutno) AS layoutno, any_value(col_id) AS col_id, round(min(x0), 2) AS x0, round(min(top), 2) AS top, round(max(x1), 2) AS x1, round(max(bottom), 2) AS bottom, string_agg(box_id, ',' ORDER BY rn) AS box_ids FROM runs GROUP BY 1, 2, 3),
sec AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY run) AS section_ord FROM sec0 WHERE text <> ''),
size AS (SELECT doc_id, page, max(page_width) AS w, max(page_height) AS h FROM b0 GROUP BY 1, 2),
reg0 AS (SELECT 'p' || lpad(page::VARCHAR, greatest(3, length(page::VARCHAR))::INT, '0') || '-table-' || lpad(ord::VARCHAR, 3, '0') AS region_id, doc_id, page, 'table' AS type, bbox[1] AS x0, bbox[2] AS top, bbox[3] AS x1, bbox[4] AS bottom, 'pdfplumber_table' AS source FROM tabs WHERE len(bbox) = 4
  UNION ALL SELECT box_id || '-' || layout_type, doc_id, page, layout_type, x0, top, x1, bottom, 'repeated_margin' FROM tag WHERE layout_type IN ('header', 'footer')),
reg AS (SELECT region_id, doc_id, page, type, greatest(0, least(x0, coalesce(nullif(w, 0), x0))) AS x0, greatest(0, least(top, coalesce(nullif(h, 0), top))) AS top, greatest(0, least(x1, coalesce(nullif(w, 0), x1))) AS x1, greatest(0, least(bottom, coalesce(nullif(h, 0), bottom))) AS bottom, source FROM reg0 JOIN size USING (doc_id, page))"""
_FREE = f"SELECT b.* FROM {S.BOXES} b ANTI JOIN {S.TABLES} t ON t.doc_id = b.doc_id AND t.page = b.page AND {_OVER.replace('>= 0.45', '>= 0.25')}"
_CELLS = f"""SELECT table_id || '-r' || c.row || 'c' || c.col AS box_id, table_id AS doc_id, page, c.text AS text, c.bbox[1] AS x0, c.bbox[2] AS top, c.bbox[3] AS x1, c.bbox[4] AS bottom, k - 1 AS box_ord FROM (SELECT table_id, doc_id, page, unnest(cells) AS c, unnest(generate_series(1, len(cells))) AS k FROM {S.TABLES}) WHERE len(c.bbox) = 4
  UNION ALL SELECT table_id || '-caption', table_id, page, caption, bbox[1], bbox[2] - 20, bbox[3], bbox[2] - 8, -1 FROM {S.TABLES} WHERE len(bbox) = 4 AND caption IS NOT NULL"""


def _rows_sql(boxes: str) -> str:
    """CTEs that end in f: box_id, row."""
    return f"""u AS (SELECT * FROM ({boxes}) b WHERE coalesce(text, '') <> '' AND length(text) <= 120 AND NOT ({_NUM})),
med AS (SELECT doc_id, page, greatest(3, 0.65::DOUBLE * list_sort(list(greatest(1, bottom - top)))[(count(*) // 2 + 1)::INT]) AS near FROM u GROUP BY 1, 2),
o AS (SELECT u.doc_id, u.page, box_id, (top + bottom) / 2 AS m, near, row_number() OVER (PARTITION BY u.doc_id, u.page ORDER BY (top + bottom) / 2, x0, box_ord) AS k FROM u JOIN med ON med.doc_id = u.doc_id AND med.page = u.page),
f AS (SELECT doc_id, page, box_id, k, near, 1 AS row, m AS mean, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page, o.box_id, o.k, o.near, CASE WHEN abs(o.m - f.mean) <= o.near THEN f.row ELSE f.row + 1 END, CASE WHEN abs(o.m - f.mean) <= o.near THEN (f.mean * f.n + o.m) / (f.n + 1) ELSE o.m END, CASE WHEN abs(o.m - f.mean) <= o.near THEN f.n + 1 ELSE 1 END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1)"""


def _detected_sql(boxes: str, known: str) -> str:
    figure = f"regexp_matches({S.strip("translate(u.text, ',%％', '')")}, '^(-|—|--|－|\\(?[-+]?{_D}+(\\.{_D}+)?\\)?|{_D}{{4}}[A-Z]?)$')"
    told = S.norm("t")
    fit = lambda k: f"CASE WHEN t{k} <> '' AND head_top - b{k} BETWEEN 0 AND 24 AND (regexp_matches({S.bare(f't{k}')}, '^(表|图表|图|资料来源|数据来源|来源)') OR contains(t{k}, '表') OR contains(t{k}, '数据')) THEN t{k} END"
    return f"""WITH RECURSIVE {_rows_sql(boxes)},
r AS (SELECT u.*, f.row AS row, row_number() OVER (PARTITION BY u.doc_id, u.page, f.row ORDER BY u.x0, k) AS col, {figure} AS fig, regexp_matches(u.text, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]') AS word FROM u JOIN f USING (box_id)),
l0 AS (SELECT doc_id, page, row, count(*) AS n, count_if(fig) AS figs, bool_or(word) AS word, string_agg(text, ' ' ORDER BY col) AS t, max(bottom) AS b FROM r GROUP BY 1, 2, 3),
l AS (SELECT *, lag(n) OVER w AS gap, lag({told}) OVER w AS t1, lag(b) OVER w AS b1, lag({told}, 2) OVER w AS t2, lag(b, 2) OVER w AS b2 FROM l0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY row)),
k0 AS (SELECT *, row - lag(row) OVER (PARTITION BY doc_id, page ORDER BY row) AS step FROM l WHERE n >= 4 AND figs >= 2 AND word),
k1 AS (SELECT *, sum(CASE WHEN step = 1 OR step = 2 AND gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY row) AS island FROM k0),
k2 AS (SELECT doc_id, page, island, row_number() OVER (PARTITION BY doc_id, page ORDER BY island) AS run FROM k1 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
m AS (SELECT r.*, k2.run, t1, b1, t2, b2, min(r.row) OVER (PARTITION BY r.doc_id, r.page, k2.run) AS head FROM r JOIN k1 ON k1.doc_id = r.doc_id AND k1.page = r.page AND k1.row = r.row JOIN k2 ON k2.doc_id = k1.doc_id AND k2.page = k1.page AND k2.island = k1.island),
e AS (SELECT doc_id, page, run, max_by(x1, col) + 12 AS edge FROM m WHERE row = head AND fig GROUP BY 1, 2, 3),
q AS (SELECT m.*, count(*) OVER w AS n, count_if(fig) OVER w AS figs FROM m JOIN e USING (doc_id, page, run) WHERE x0 <= edge WINDOW w AS (PARTITION BY doc_id, page, run, row)),
g AS (SELECT doc_id, page, run FROM (SELECT doc_id, page, run, row, any_value(n) AS n, any_value(figs) AS figs FROM q WHERE n >= 3 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count_if(n >= 4) >= 3 AND count_if(figs >= 2) / count(*) >= 0.65),
c AS (SELECT q.*, dense_rank() OVER (PARTITION BY doc_id, page, run ORDER BY row) - 1 AS rr, row_number() OVER (PARTITION BY doc_id, page, run, row ORDER BY col) - 1 AS cc FROM q JOIN g USING (doc_id, page, run) WHERE n >= 3),
z AS (SELECT doc_id, page, run, round(min(x0), 2) AS x0, round(min(top), 2) AS top, round(max(x1), 2) AS x1, round(max(bottom), 2) AS bottom, max(n) AS columns, min(top) FILTER (WHERE rr = 0) AS head_top, any_value(t1) FILTER (WHERE rr = 0) AS t1, any_value(b1) FILTER (WHERE rr = 0) AS b1, any_value(t2) FILTER (WHERE rr = 0) AS t2, any_value(b2) FILTER (WHERE rr = 0) AS b2,
  string_agg(rr || ',' || cc || ',' || box_id, ' ' ORDER BY rr, cc) AS cells FROM c GROUP BY 1, 2, 3)
SELECT {S.number_id(S.number_id("doc_id", "p", "page"), "layout-t", "run")} AS table_id, doc_id, page, coalesce({fit(1)}, {fit(2)}, '') AS caption, x0, top, x1, bottom, cells FROM z
WHERE columns >= 3 AND NOT EXISTS (SELECT 1 FROM ({known}) t WHERE t.doc_id = z.doc_id AND t.page = z.page AND len(t.bbox) = 4 AND greatest(0, least(z.x1, t.bbox[3]) - greatest(z.x0, t.bbox[1])) * greatest(0, least(z.bottom, t.bbox[4]) - greatest(z.top, t.bbox[2])) / greatest(1, (z.x1 - z.x0) * (z.bottom - z.top)) >= 0.25)"""


QUERIES = {f.__name__: f for f in (layout_repeated_margins, layout_tags, layout_regions, layout_columns, layout_captions, layout_sections, layout_pages, pages_record, layout_rows, layout_detected_tables, layout_redetected_tables)}
SQL = {
    "layout_repeated_margins": lambda: f"WITH {_BASE} SELECT doc_id, text FROM rep",
    "layout_tags": lambda: f"WITH {_BASE} SELECT box_id, layout_type, layoutno FROM tag",
    "layout_regions": lambda: f"WITH {_BASE} SELECT * FROM reg",
    "layout_columns": lambda: f"WITH {_BASE} SELECT box_id, col_id FROM cols",
    "layout_captions": lambda: f"""WITH {_BASE} SELECT table_id, max_by(text, box_ord) AS caption FROM (SELECT c.text, c.box_ord, t.table_id, abs(c.bottom - t.bbox[2]) AS distance, row_number() OVER (PARTITION BY c.box_id ORDER BY abs(c.bottom - t.bbox[2]), t.ord) AS rank FROM tag c JOIN tabs t ON t.doc_id = c.doc_id AND t.page = c.page
      WHERE c.layout_type = 'table caption' AND len(t.bbox) = 4 AND c.x1 >= t.bbox[1] AND c.x0 <= t.bbox[3]) WHERE rank = 1 AND distance <= 80 GROUP BY table_id""",
    "layout_sections": lambda: f"WITH {_BASE} SELECT {S.number_id(S.number_id('doc_id', 'p', 'page'), 's', 'section_ord')} AS section_id, doc_id, page, text, layout_type, layoutno, col_id, x0, top, x1, bottom, box_ids FROM sec",
    "layout_pages": lambda: f"""WITH {_BASE} SELECT b.doc_id, b.page, {S.norm("coalesce(any_value(s.text), '')")} AS text, coalesce(any_value(s.n), 0)::INT AS section_count, count(*) AS text_box_count, coalesce(any_value(r.n), 0) AS layout_region_count, coalesce(any_value(t.n), 0) AS table_count FROM b0 b
      LEFT JOIN (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY section_ord) AS text, count(*) AS n FROM sec GROUP BY 1, 2) s USING (doc_id, page) LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM reg GROUP BY 1, 2) r USING (doc_id, page) LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM tabs GROUP BY 1, 2) t USING (doc_id, page) GROUP BY b.doc_id, b.page""",
    "pages_record": lambda: f"""WITH {_BASE}, cap AS (SELECT table_id, max_by(text, box_ord) AS said FROM (SELECT c.text, c.box_ord, t.table_id, abs(c.bottom - t.bbox[2]) AS distance, row_number() OVER (PARTITION BY c.box_id ORDER BY abs(c.bottom - t.bbox[2]), t.ord) AS rank FROM tag c JOIN tabs t ON t.doc_id = c.doc_id AND t.page = c.page
      WHERE c.layout_type = 'table caption' AND len(t.bbox) = 4 AND c.x1 >= t.bbox[1] AND c.x0 <= t.bbox[3]) WHERE rank = 1 AND distance <= 80 GROUP BY table_id), meta AS (SELECT doc_id, {S.strip("file_path")} AS source, {S.strip("coalesce(title, '')")} AS title, CASE WHEN regexp_matches({S.strip("coalesce(pages, '')")}, '^[+-]?[0-9]+$') THEN try_cast({S.strip("coalesce(pages, '')")} AS INTEGER) END AS expected_pages FROM doc_manifest QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY file_path) = 1)
      SELECT b.doc_id, any_value(meta.source) AS source, b.page, {S.norm("coalesce(any_value(s.text), '')")} AS text, coalesce(any_value(s.ids), '') AS sections, coalesce(any_value(t.ids), '') AS tables, coalesce(any_value(r.ids), '') AS layout_regions, string_agg(concat_ws(',', b.box_id, b.layout_type, b.layoutno, b.col_id), ' ' ORDER BY b.box_ord, b.box_id) AS text_boxes, any_value(meta.title) AS title, any_value(meta.expected_pages) AS expected_pages,
      count(*)::INT AS text_box_count, coalesce(any_value(r.n), 0)::INT AS layout_region_count, coalesce(any_value(t.n), 0)::INT AS table_count, 'deepdoc_style_local' AS parser_name FROM cols b LEFT JOIN meta ON meta.doc_id = b.doc_id
      LEFT JOIN (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY section_ord) AS text, string_agg(concat_ws(',', {S.number_id(S.number_id('doc_id', 'p', 'page'), 's', 'section_ord')}, layout_type, col_id), ' ' ORDER BY section_ord) AS ids FROM sec GROUP BY 1, 2) s ON s.doc_id = b.doc_id AND s.page = b.page
      LEFT JOIN (SELECT doc_id, page, string_agg(region_id || ',' || type, ' ' ORDER BY region_id) AS ids, count(*) AS n FROM reg GROUP BY 1, 2) r ON r.doc_id = b.doc_id AND r.page = b.page
      LEFT JOIN (SELECT doc_id, page, string_agg(table_id || ',' || coalesce(said, caption), ' ' ORDER BY ord) AS ids, count(*) AS n FROM tabs LEFT JOIN cap USING (table_id) GROUP BY 1, 2) t ON t.doc_id = b.doc_id AND t.page = b.page GROUP BY b.doc_id, b.page""",
    "layout_rows": lambda: f"WITH RECURSIVE {_rows_sql(_FREE)} SELECT box_id, row::INT AS row FROM f",
    "layout_detected_tables": lambda: _detected_sql(_FREE, S.TABLES),
    "layout_redetected_tables": lambda: _detected_sql(_CELLS, f"SELECT * FROM {S.TABLES} LIMIT 0"),
}
