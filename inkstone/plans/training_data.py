"""Queries of the core operator for training data: quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.functions.glyphs import fold
from inkstone.operators import units
from inkstone.plans import sql as S
from inkstone.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.contradictions(units.figures(table(spark, d, "structured_tables"), table(spark, d, "glossary_terms")))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every figure of a measured term as a value in the measure's common unit."""
    return units.figures(table(spark, d, "structured_tables"), table(spark, d, "glossary_terms"))


def _stated(c: str) -> str:
    """What a header or caption may state of units."""
    return f"""coalesce(nullif(trim(regexp_extract({c}, '单位\\s*[:为]\\s*([^,()]*)\\)?\\s*$', 1)), ''), nullif(trim(regexp_extract({c}, '\\(([^()]*)\\)\\s*$', 1)), ''), nullif(trim(regexp_extract({c}, '[,，]\\s*([^,，()]*)$', 1)), ''))"""


def _bare(c: str) -> str:
    """A spelling without the words around a unit."""
    words = f"regexp_replace(regexp_replace({c}, '单位|人民币|另有注明除外|unless (otherwise )?stated|为|[:()\\[\\],，、]', ' ', 'gi'), '^\\s*in ', '')"
    return f"trim(regexp_replace({words}, '\\s+', ' ', 'g'), ' ')"


def _values_sql(columns: str) -> str:
    """Figures by exact spellings, which is all that the data hold once look-alikes are replaced."""
    known = ", ".join(f"({S.text(fold(s.replace('_', ' ')))}, '{m}', {float(size)!r}::DOUBLE)" for m, sizes in units.UNITS.items() for size, names in sizes.items() for s in names.split())
    folded = lambda c: f"trim({S.looks(c)}, ' ')"
    number = units.NUMBER.replace("'", "''")
    part = lambda k: f"regexp_extract(text, '{number}', {k})"
    unit = lambda n, key: f"LEFT JOIN u {n} ON {n}.spelling = {key}"
    return f"""
WITH u(spelling, measure, size) AS (VALUES {known}), g AS (SELECT term_id, measure, {folded("term")} AS term FROM glossary_terms WHERE term IS NOT NULL AND measure IS NOT NULL),
t AS {S.TABLES}, c AS (SELECT table_id, doc_id, page, caption, c.row AS r, c.col AS k, c.text AS text FROM (SELECT table_id, doc_id, page, caption, unnest(cells) AS c FROM t)),
l AS (SELECT DISTINCT text, {folded("text")} AS label FROM c WHERE k = 0 AND r > 0 AND text IS NOT NULL),
m AS (SELECT text, term_id, measure, label, term, trim(substring(label, length(term) + 1), ' ') AS rest FROM l JOIN g ON starts_with(label, term) QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(term) DESC) = 1),
n AS (SELECT m.text, term_id, m.measure, lu.measure AS label_measure, lu.size AS label_size FROM m {unit("lu", _bare("rest"))} WHERE rest = '' OR lu.size IS NOT NULL AND regexp_matches(rest, '^[(\\[,，、:/]')),
b AS (SELECT c.table_id, c.doc_id, c.page, c.r, c.k, {folded("c.text")} AS text, side.text AS label, {folded("head.text")} AS header, {folded("corner.text")} AS corner, {folded("c.caption")} AS caption FROM c
  LEFT JOIN c side ON side.table_id = c.table_id AND side.r = c.r AND side.k = 0 LEFT JOIN c head ON head.table_id = c.table_id AND head.r = 0 AND head.k = c.k LEFT JOIN c corner ON corner.table_id = c.table_id AND corner.r = 0 AND corner.k = 0 WHERE c.r > 0 AND c.k > 0 AND c.text IS NOT NULL),
p AS (SELECT *, replace({part(5)}, ',', '')::DOUBLE * CASE WHEN {part(2)} = '-' OR {part(4)} = '-' OR ({part(1)} = '(' AND {part(6)} = ')') THEN -1 ELSE 1 END AS number, nullif(trim(concat_ws(' ', nullif({part(3)}, ''), nullif(trim({part(7)}), ''))), '') AS cell_unit,
  regexp_extract(header, '(^|[^0-9])((?:19|20)[0-9]{{2}})([^0-9]|$)', 2) AS year, {_stated("header")} AS header_unit, coalesce({_stated("corner")}, CASE WHEN regexp_matches(corner, '单位|元$|RMB') THEN corner END) AS corner_unit, {_stated("caption")} AS caption_unit FROM b WHERE regexp_matches(text, '{number}')),
v AS (SELECT doc_id, page, table_id, table_id || '-r' || r || 'c' || k AS cell_id, term_id, n.measure, year::INT AS year, number,
  number * coalesce(CASE WHEN cu.measure = n.measure THEN cu.size END, CASE WHEN cu.size IS NULL THEN coalesce(CASE WHEN label_measure = n.measure THEN label_size END, CASE WHEN hu.measure = n.measure THEN hu.size END, CASE WHEN n.measure = 'money' THEN coalesce(CASE WHEN ku.measure = 'money' THEN ku.size END, CASE WHEN tu.measure = 'money' THEN tu.size END) END) END) AS value
  FROM p JOIN n ON n.text = p.label {unit("cu", _bare("cell_unit"))} {unit("hu", _bare("header_unit"))} {unit("ku", _bare("corner_unit"))} {unit("tu", _bare("caption_unit"))} WHERE year <> '' AND (cell_unit IS NULL OR cu.size IS NOT NULL))
{columns}"""


QUERIES = {"p2_found": p2_found, "p2_values": p2_values}
SQL = {
    "p2_values": lambda: _values_sql("SELECT * FROM v WHERE value IS NOT NULL"),
    "p2_found": lambda: _values_sql("SELECT DISTINCT least(x.cell_id, y.cell_id) AS cell_a, greatest(x.cell_id, y.cell_id) AS cell_b FROM v x JOIN v y USING (doc_id, page, term_id, year) WHERE x.table_id <> y.table_id AND x.cell_id < y.cell_id AND abs(x.value - y.value) > 0.01::DOUBLE * greatest(abs(x.value), abs(y.value))"),
}
