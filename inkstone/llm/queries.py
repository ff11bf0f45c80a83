"""The queries of the training-text operators and, where it can express them, their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bisect_split, cut_detect, glyph_unify, leak_search, mix_sources, near_duplicates, quality_stats
from inkstone.plans import sql as S
from inkstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items = glyph_unify.text_items(table(spark, d, "text_boxes"), table(spark, d, "structured_tables"))
    return glyph_unify.disguised_terms(items, table(spark, d, "glossary_terms"), glyph_unify.corpus_rewriter(items))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every text of boxes and cells in its one consistent form."""
    items = glyph_unify.text_items(table(spark, d, "text_boxes"), table(spark, d, "structured_tables"))
    return glyph_unify.unify(items, "text", glyph_unify.corpus_rewriter(items))


def p1_sql() -> str:
    return f"""
WITH items AS (
  SELECT 'box' AS item_kind, box_id AS item_id, text FROM text_boxes
  UNION ALL
  SELECT 'cell', table_id || '-r' || c.row || 'c' || c.col, c.text FROM (SELECT table_id, unnest(cells) AS c FROM structured_tables)
), looks AS (SELECT *, trim({S.looks("text")}, ' ') AS look FROM items WHERE text IS NOT NULL AND item_id IS NOT NULL),
terms AS (SELECT term_id, term, trim({S.looks("term")}, ' ') AS look FROM glossary_terms WHERE term IS NOT NULL)
SELECT DISTINCT item_kind, item_id, term_id FROM looks JOIN terms USING (look) WHERE trim(text, ' ') <> term"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality_stats.not_prose(table(spark, d, "chunks"), table(spark, d, "chunk_labels"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic of every chunk with its percentile, robust z-score and tail flags, and the kind that follows."""
    stats = quality_stats.described(table(spark, d, "chunks"))
    return quality_stats.kinds(stats, table(spark, d, "chunk_labels"), with_scores=True)


def p3_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Per statistic whether all percentiles are right to 0.01, by exact counts of all chunks of each language."""
    stats = quality_stats.described(table(spark, d, "chunks"))
    errors = quality_stats.rank_errors(stats, quality_stats.quantiles(stats, own_only=True))
    return errors.groupBy("statistic").agg((F.max("error") <= 0.01).alias("right"))


def p3_ranks_sql() -> str:
    return f"SELECT unnest([{', '.join(S.text(s) for s in quality_stats.STATS)}]) AS statistic, true AS right"


def _split(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    things = bisect_split.items(table(spark, d, "parsed_pages"), table(spark, d, "structured_tables"))
    return bisect_split.split_items(things, table(spark, d, "split_limits"), with_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, False).select("item_kind", "item_id", "cut").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all oversized items."""
    return _split(spark, d, True)


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The oversized items put together again from their pieces, and whether these keep the limit and the overlap."""
    whole, limits = bisect_split.rebuilt(p4_pieces(spark, d)), table(spark, d, "split_limits")
    kept = (F.col("longest") <= F.col("max_chars")) & (F.size("overlaps") == 1) & (F.col("overlaps")[0] == F.coalesce("overlap_chars", F.lit(0)))
    return whole.join(F.broadcast(limits), "item_kind").select("item_kind", "item_id", "text", kept.alias("kept"))  # a row per kind


def p4_rebuilt_sql() -> str:
    return f"WITH {_over_sql()} SELECT DISTINCT item_kind, item_id, text, true AS kept FROM over"


def _over_sql() -> str:
    return """things AS (
  SELECT 'section' AS item_kind, s.section_id AS item_id, s.text AS text, NULL AS rows FROM (SELECT unnest(sections) AS s FROM parsed_pages)
  UNION ALL SELECT 'page', doc_id || '-p' || CASE WHEN length(page::VARCHAR) < 3 THEN lpad(page::VARCHAR, 3, '0') ELSE page::VARCHAR END, text, NULL FROM parsed_pages
  UNION ALL SELECT 'table', table_id, array_to_string(list_filter(list_transform(protected_rows, lambda r: r.text), lambda t: t IS NOT NULL), chr(10)), list_filter(list_transform(protected_rows, lambda r: r.text), lambda t: t IS NOT NULL) FROM structured_tables
), over AS (SELECT * FROM things JOIN split_limits USING (item_kind) WHERE length(text) > max_chars AND item_id IS NOT NULL)"""


def p4_sql() -> str:
    closers = bisect_split.CLOSERS.replace("'", "''").replace("]", r"\]")
    mark = "chr(1)"
    broken = rf"""regexp_replace(regexp_replace(regexp_replace(text, '(\n\s*\n)', {mark} || '\1' || {mark}, 'g'), '([。！？][{closers}]*)', '\1' || {mark}, 'g'), '([.!?][{closers}]*)(\s|{chr(1)})', '\1' || {mark} || '\2', 'g')"""
    return f"""
WITH {_over_sql()},
stretches AS (SELECT item_kind, item_id, max_chars, CASE WHEN rows IS NULL THEN list_transform(string_split({broken}, {mark}), lambda x: length(x))
  ELSE list_transform(rows, lambda x, i: length(x) + CASE WHEN i > 1 THEN 1 ELSE 0 END) END AS sizes FROM over)
SELECT DISTINCT item_kind, item_id, CASE WHEN list_max(sizes) > max_chars THEN 'forced' ELSE 'boundary' END AS cut FROM stretches"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(table(spark, d, "chunks"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class of near-duplicates every chunk is in, the text it holds, and its number of links."""
    return near_duplicates.groups(table(spark, d, "chunks"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between different texts, a text standing for all of its copies."""
    return near_duplicates.text_links(table(spark, d, "chunks"))


def _links_sql() -> str:
    """CTEs that compare every text with every other that has an 8-gram in common: m (chunk_id, id), links (x, y)."""
    solid, least, share = S.bare("text"), near_duplicates.LEAST, near_duplicates.SHARE
    return f"""c AS (SELECT DISTINCT chunk_id, {solid} AS t FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND length({solid}) >= {least}),
x AS (SELECT t, min(chunk_id) AS id, length(t) AS n FROM c GROUP BY t), m AS (SELECT c.chunk_id, x.id FROM c JOIN x USING (t)),
g AS (SELECT id, n, k, substring(t, k, 8) AS gram FROM (SELECT *, unnest(generate_series(1, n - 7)) AS k FROM x)), u AS (SELECT DISTINCT id, gram FROM g),
many AS (SELECT g.id AS a, u.id AS b FROM g JOIN u USING (gram) WHERE g.id <> u.id GROUP BY 1, 2 HAVING count(*) * 8 >= {share}::DOUBLE * any_value(g.n)),
step AS (SELECT g.id AS a, u.id AS b, n, lead(k) OVER (PARTITION BY g.id, u.id ORDER BY k) - k AS step FROM g JOIN u USING (gram) SEMI JOIN many ON many.a = g.id AND many.b = u.id),
held AS (SELECT a, b FROM step GROUP BY 1, 2 HAVING sum(least(8, coalesce(step, 8))) / any_value(n) >= {share}::DOUBLE),
links AS (SELECT p.a AS x, p.b AS y FROM held p JOIN held q ON q.a = p.b AND q.b = p.a WHERE p.a < p.b), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links)"""


def p5_sql() -> str:
    return f"""WITH {_links_sql()}, tx AS (SELECT x, y FROM links UNION SELECT p.x, q.x FROM ways p JOIN ways q ON p.y = q.y WHERE p.x < q.x)
SELECT DISTINCT least(p.chunk_id, q.chunk_id) AS chunk_a, greatest(p.chunk_id, q.chunk_id) AS chunk_b FROM tx JOIN m p ON p.id = tx.x JOIN m q ON q.id = tx.y WHERE p.chunk_id <> q.chunk_id UNION SELECT p.chunk_id, q.chunk_id FROM m p JOIN m q ON p.id = q.id WHERE p.chunk_id < q.chunk_id"""


def p5_links_sql() -> str:
    return f"WITH {_links_sql()} SELECT x AS text_a, y AS text_b FROM links"


def p5_groups_sql() -> str:
    return f"""WITH RECURSIVE {_links_sql()}, reach AS (SELECT id AS a, id AS b FROM x UNION SELECT reach.a, ways.y FROM reach JOIN ways ON ways.x = reach.b),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1), deg AS (SELECT x AS id, count(*) AS links FROM ways GROUP BY 1)
SELECT m.chunk_id, class_id, m.id AS text_id, coalesce(links, 0)::BIGINT AS links FROM m JOIN class ON class.a = m.id LEFT JOIN deg ON deg.id = m.id"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_search.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


@cache
def _compatible() -> tuple[str, str]:
    pairs = {}
    for cp in range(0x80, 0x30000):
        n = unicodedata.normalize("NFKC", chr(cp)).casefold()
        if len(n) == 1 and n != chr(cp) and not unicodedata.combining(chr(cp)):
            pairs[chr(cp)] = n
    return "".join(pairs), "".join(pairs.values())


def skeleton(c: str) -> str:
    """Letters and digits of a text, compatibility forms and case aside (characters that become several are left as they are)."""
    return f"regexp_replace(lower(translate(nfc_normalize({c}), {S.text(_compatible()[0])}, {S.text(_compatible()[1])})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def p6_sql() -> str:
    """Every stretch of half an answer, and every query, looked for in every document."""
    return f"""
WITH d AS (SELECT doc_id, {skeleton("text")} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, {skeleton("coalesce(query, '')")} AS q, {skeleton("coalesce(answer, '')")} AS a FROM eval_items WHERE item_id IS NOT NULL),
w AS (SELECT item_id, substring(a, k, (length(a) + 1) // 2) AS p FROM (SELECT item_id, a, unnest(generate_series(1, length(a) - (length(a) + 1) // 2 + 1)) AS k FROM i WHERE a <> '') UNION SELECT item_id, q FROM i WHERE q <> '')
SELECT DISTINCT doc_id, item_id FROM d JOIN w ON contains(d.t, w.p)"""


def _planned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    sized = mix_sources.sized_documents(table(spark, d, "documents"))
    targets, budget = table(spark, d, "mix_targets"), mix_sources.budget_of(sized)
    planned = mix_sources.schedule(sized, targets)
    return planned, mix_sources.ledger(planned, targets, budget), budget


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, book, _ = _planned(spark, d)
    return book.where("short").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The copies of documents that make up the mixture, in its order."""
    return mix_sources.mixture(*_planned(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    planned, book, budget = _planned(spark, d)
    return mix_sources.shares(mix_sources.mixture(planned, book, budget), book)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return cut_detect.cut_texts(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("cut").select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts off."""
    return cut_detect.rates(_scored(spark, d))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_unified": p1_unified, "p3_found": p3_found, "p3_statistics": p3_statistics, "p3_ranks": p3_ranks, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rebuilt": p4_rebuilt, "p5_found": p5_found, "p5_groups": p5_groups, "p5_links": p5_links, "p6_found": p6_found,
                             "p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_rates": p8_rates}
SQL: dict[str, Callable[[], str]] = {"p1_found": p1_sql, "p3_ranks": p3_ranks_sql, "p4_found": p4_sql, "p4_rebuilt": p4_rebuilt_sql, "p5_found": p5_sql, "p5_links": p5_links_sql, "p5_groups": p5_groups_sql, "p6_found": p6_sql}
