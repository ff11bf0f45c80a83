"""Queries and SQL of table structuring."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import chunking as C
from inkstone.operators import tables as T
from inkstone.plans import sql as S
from inkstone.session import table


def _tables(spark, d):
    return C.latest(table(spark, d, "structured_tables"), ["table_id"], "parsed_at")


def _boxes(spark, d):
    return C.latest(table(spark, d, "text_boxes"), ["box_id"], "loaded_at")


def table_matrix(spark, d):
    out = T.with_matrix(_tables(spark, d)).select("table_id", F.explode("matrix_").alias("r"))
    return out.select("table_id", "r.row", F.posexplode("r.texts").alias("col", "text"))


def table_header_rows(spark, d):
    return T.with_headers(T.with_matrix(_tables(spark, d))).select("table_id", F.explode("header_rows_").alias("row"))


def table_column_headers(spark, d):
    return T.with_headers(T.with_matrix(_tables(spark, d))).select("table_id", F.explode("headers_").alias("h")).select("table_id", "h.col", "h.text")


def table_row_texts(spark, d):
    return T.structured(_tables(spark, d)).select("table_id", F.explode("rows_").alias("r")).select("table_id", "r.row", "r.text", "r.is_header", "r.cell_count", F.array_join("r.cell_ids", ",").alias("cell_ids"))


def table_markdown(spark, d):
    return T.structured(_tables(spark, d)).select("table_id", F.col("markdown_").alias("markdown"))


def table_text(spark, d):
    return T.structured(_tables(spark, d)).select("table_id", F.col("text_").alias("text"))


def table_html(spark, d):
    t = T.with_headers(T.with_matrix(_tables(spark, d)))
    return t.select("table_id", T.html(F.col("caption"), F.col("matrix_"), F.col("header_rows_"), F.col("cells")).alias("html"))


def table_spans(spark, d):
    return T.spans(_tables(spark, d))


def table_cell_boxes(spark, d):
    return T.cell_boxes(_tables(spark, d), _boxes(spark, d)).drop("ids")


def table_page_ranges(spark, d):
    """Every table with its pages."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return T.page_ranges(_tables(spark, d)).select("table_id", "doc_id", joined("pages"), joined("parts"))


_BASE = f"""t AS {S.TABLES},
c0 AS (SELECT table_id, c.row AS row, c.col AS col, {S.norm("coalesce(c.text, '')")} AS text, c.col_span AS cs, c.row_span AS rs, k FROM (SELECT table_id, unnest(cells) AS c, unnest(generate_series(1, len(cells))) AS k FROM t) WHERE c.row IS NOT NULL AND c.col IS NOT NULL),
c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY table_id, row, col ORDER BY k DESC) = 1),
filled AS (SELECT DISTINCT table_id, row FROM c0 WHERE text <> ''),
wide AS (SELECT table_id, max(col) AS last FROM c0 GROUP BY table_id),
m AS (SELECT f.table_id, f.row, g.col, coalesce(c.text, '') AS text FROM filled f JOIN wide w USING (table_id), LATERAL (SELECT unnest(generate_series(0, w.last))::INT AS col) g LEFT JOIN c ON c.table_id = f.table_id AND c.row = f.row AND c.col = g.col),
ranked AS (SELECT table_id, row, row_number() OVER (PARTITION BY table_id ORDER BY row) AS k FROM filled),
num AS (SELECT m.*, ({S.strip("translate(text, ',%％', '')")}) AS x FROM m WHERE text <> ''),
heads AS (SELECT r.table_id, r.row FROM ranked r WHERE k = 1 UNION ALL
  SELECT r.table_id, r.row FROM ranked r JOIN num USING (table_id, row) WHERE k = 2 GROUP BY r.table_id, r.row
  HAVING count_if(NOT (length(x) > 0 AND length(regexp_replace(x, '[^\\p{{Nd}}.\\-+()/]', '', 'g')) / greatest(length(x), 1) >= 0.65)) / count(*) >= 0.6),
ch AS (SELECT table_id, col, string_agg(text, '的' ORDER BY row) AS text FROM m SEMI JOIN heads USING (table_id, row) WHERE text <> '' GROUP BY table_id, col),
texts AS (SELECT m.table_id, m.row, (h.row IS NOT NULL) AS is_header,
    coalesce(string_agg(CASE WHEN m.text <> '' THEN m.text END, ' | ' ORDER BY m.col), '') AS head_text,
    coalesce(string_agg(CASE WHEN m.text <> '' THEN coalesce(ch.text || ': ', '') || m.text END, '; ' ORDER BY m.col), '') AS row_text
  FROM m LEFT JOIN heads h ON h.table_id = m.table_id AND h.row = m.row LEFT JOIN ch ON ch.table_id = m.table_id AND ch.col = m.col GROUP BY ALL),
counts AS (SELECT table_id, row, count(*)::INT AS cell_count, string_agg('r' || row || 'c' || col, ',' ORDER BY col) AS cell_ids FROM c0 GROUP BY table_id, row),
rows AS (SELECT x.table_id, x.row, {S.norm("CASE WHEN is_header THEN head_text WHEN coalesce(t.caption, '') <> '' AND row_text <> '' THEN row_text || chr(9) || '-- 来自「' || t.caption || '」' ELSE row_text END")} AS text, is_header, cell_count, cell_ids
  FROM texts x JOIN t USING (table_id) JOIN counts USING (table_id, row)),
md AS (SELECT t.table_id, coalesce(CASE WHEN any_value(w.last) IS NULL OR count(l.row) = 0 THEN NULL ELSE concat_ws(chr(10), nullif(any_value(t.caption), ''), min_by(l.line, l.row), '| ' || array_to_string(list_transform(generate_series(0, any_value(w.last)), lambda i: '---'), ' | ') || ' |', string_agg(CASE WHEN l.k > 1 THEN l.line END, chr(10) ORDER BY l.row)) END, '') AS markdown
  FROM t LEFT JOIN wide w USING (table_id) LEFT JOIN (SELECT m.table_id, m.row, any_value(k) AS k, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line FROM m JOIN ranked USING (table_id, row) GROUP BY m.table_id, m.row) l USING (table_id) GROUP BY t.table_id)"""
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _html_sql() -> str:
    return f"""WITH {_BASE}, line AS (SELECT m.table_id, m.row, '<tr>' || chr(10) || string_agg('<' || tag || CASE WHEN coalesce(c.cs, 1) > 1 THEN ' colspan="' || c.cs || '"' ELSE '' END || CASE WHEN coalesce(c.rs, 1) > 1 THEN ' rowspan="' || c.rs || '"' ELSE '' END || '>' || {_ESC.format("m.text")} || '</' || tag || '>', chr(10) ORDER BY m.col) || chr(10) || '</tr>' AS html
      FROM (SELECT m.*, CASE WHEN h.row IS NULL THEN 'td' ELSE 'th' END AS tag FROM m LEFT JOIN heads h ON h.table_id = m.table_id AND h.row = m.row) m JOIN c ON c.table_id = m.table_id AND c.row = m.row AND c.col = m.col GROUP BY m.table_id, m.row)
    SELECT t.table_id, concat_ws(chr(10), '<table>', CASE WHEN coalesce(any_value(caption), '') <> '' THEN '<caption>' || {_ESC.format("any_value(caption)")} || '</caption>' END, string_agg(line.html, chr(10) ORDER BY line.row), '</table>') AS html FROM t LEFT JOIN line USING (table_id) GROUP BY t.table_id"""


_SPANS = f"""WITH t AS {S.TABLES}, c AS (SELECT table_id, c.row AS row, c.col AS col, list_transform(c.bbox, lambda v: round(v, 2)) AS b FROM (SELECT table_id, unnest(cells) AS c FROM t) WHERE len(c.bbox) = 4),
r AS (SELECT table_id, row, max(b[2]) AS a, min(b[4]) AS z FROM c GROUP BY ALL), k AS (SELECT table_id, col, max(b[1]) AS a, min(b[3]) AS z FROM c GROUP BY ALL)
SELECT c.table_id, c.row, c.col, greatest(1, (SELECT count(*) FROM r WHERE r.table_id = c.table_id AND (r.a + r.z) / 2 BETWEEN c.b[2] - 1 AND c.b[4] + 1))::INT AS row_span, greatest(1, (SELECT count(*) FROM k WHERE k.table_id = c.table_id AND (k.a + k.z) / 2 BETWEEN c.b[1] - 1 AND c.b[3] + 1))::INT AS col_span FROM c"""

_CELL_BOXES = f"""WITH t AS {S.TABLES}, c AS (SELECT table_id, doc_id, page, c.row AS row, c.col AS col, c.text AS text, c.bbox AS b FROM (SELECT table_id, doc_id, page, unnest(cells) AS c FROM t) WHERE len(c.bbox) = 4), x AS (SELECT * FROM {S.BOXES} WHERE text IS NOT NULL),
j AS (SELECT c.table_id, c.row, c.col, string_agg(x.box_id, ',' ORDER BY x.top, x.x0, x.box_id) AS ids, string_agg(x.text, ' ' ORDER BY x.top, x.x0, x.box_id) AS texts FROM c JOIN x ON x.doc_id = c.doc_id AND x.page = c.page
  WHERE greatest(0, x.x1 - x.x0) * greatest(0, x.bottom - x.top) > 0 AND greatest(0, least(x.x1, c.b[3]) - greatest(x.x0, c.b[1])) * greatest(0, least(x.bottom, c.b[4]) - greatest(x.top, c.b[2])) / (greatest(0, x.x1 - x.x0) * greatest(0, x.bottom - x.top)) >= 0.45 GROUP BY ALL)
SELECT c.table_id, c.row, c.col, coalesce(j.ids, '') AS box_ids, CASE WHEN length({S.norm("coalesce(c.text, '')")}) > 0 THEN {S.norm("coalesce(c.text, '')")} ELSE {S.norm("coalesce(j.texts, '')")} END AS text FROM c LEFT JOIN j USING (table_id, row, col)"""

QUERIES = {f.__name__: f for f in (table_matrix, table_header_rows, table_column_headers, table_row_texts, table_markdown, table_text, table_html, table_spans, table_cell_boxes, table_page_ranges)}
SQL = {
    "table_matrix": lambda: f"WITH {_BASE} SELECT table_id, row, col, text FROM m",
    "table_header_rows": lambda: f"WITH {_BASE} SELECT table_id, row FROM heads",
    "table_column_headers": lambda: f"WITH {_BASE} SELECT table_id, col, text FROM ch",
    "table_row_texts": lambda: f"WITH {_BASE} SELECT * FROM rows",
    "table_markdown": lambda: f"WITH {_BASE} SELECT * FROM md",
    "table_text": lambda: f"WITH {_BASE} SELECT md.table_id, {S.norm('concat_ws(chr(10) || chr(10) || $$行级描述:$$ || chr(10), md.markdown, r.lines)')} AS text FROM md LEFT JOIN (SELECT table_id, string_agg(text, chr(10) ORDER BY row) AS lines FROM rows WHERE text <> '' GROUP BY table_id) r USING (table_id)",
    "table_html": _html_sql,
    "table_spans": lambda: _SPANS,
    "table_cell_boxes": lambda: _CELL_BOXES,
    "table_page_ranges": lambda: f"""WITH t AS {S.TABLES}, h AS (SELECT table_id, doc_id, page, coalesce(columns, -1) AS columns, array_to_string(list_transform(list_sort(list_transform(list_filter(cells, lambda c: c.row = 0 AND c.col IS NOT NULL), lambda c: {{'col': c.col, 'text': {S.norm("coalesce(c.text, '')")}}})), lambda c: c.text), '|') AS head, min(table_id) OVER p = table_id AS first, max(table_id) OVER p = table_id AS last FROM t WINDOW p AS (PARTITION BY doc_id, page)),
      r AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND first AND lag(last) OVER w AND regexp_replace(head, '[|\\s]', '', 'g') <> '' THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY doc_id, head, columns ORDER BY page, table_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, head, columns ORDER BY page, table_id) AS run FROM r)
      SELECT min_by(table_id, (page, table_id)) AS table_id, doc_id, string_agg(page::VARCHAR, ',' ORDER BY page, table_id) AS pages, string_agg(table_id, ',' ORDER BY page, table_id) AS parts FROM g GROUP BY doc_id, head, columns, run""",
}
