"""Chunks of pages: windows of sections, whole rows of tables; and statistics over parameters.

Everything is a narrow transformation of a page's row (array functions, no shuffle), so it runs as well on a
stream. Defined results: null or blank texts give no chunk; a table without data rows gives its header; a row
longer than the size is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from inkstone.functions.text import normalize_whitespace, numbered, strip
from inkstone.session import fence, materialize, small

#: Chunk size and overlap of the default comparison.
CONFIGS = ((256, 50), (512, 100), (1024, 200))


def parse_config(value: str) -> tuple[int, int]:
    """`size:overlap` or `size,overlap`."""
    parts = value.replace(",", ":").split(":")
    if len(parts) != 2:
        raise ValueError(f"not size:overlap: {value}")
    return checked(int(parts[0]), int(parts[1]))


def checked(size: int, overlap: int) -> tuple[int, int]:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    return size, overlap


def latest(df: DataFrame, keys: list[str], at: str | list[str], most: int = 400_000, wide: bool = False) -> DataFrame:
    """The last delivery of each key by the columns `at`; rows with a null in their key are all kept.

    Only keys and the first column of `at` are counted over the network; those delivered more than once (few) come back
    with their last `at`, broadcast up to `most` of them, and pick their rows in one reading. Whole rows move only for
    keys whose last `at` occurs again; or for all repeated keys, if `at` is too wide a column to count by.
    """
    first, *_ = order = [at] if isinstance(at, str) else at
    known = [F.col(k).isNotNull() for k in keys]
    counted = df.where(reduce(and_, known)).groupBy(*keys, (F.lit(None).cast(df.schema[first].dataType) if wide else F.col(first)).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    again = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max(F.struct("_at", "_n")).alias("_last")).where("_all > 1").select(*keys, F.col("_last._at").alias("_at"), F.col("_last._n").alias("_n"))
    again = materialize(again)
    out = df.join(small(again, most), keys, "left").where(F.col("_n").isNull() | ((F.col("_n") == 1) & F.col(first).eqNullSafe(F.col("_at")))).select(*df.columns)
    tied = again.where("_n > 1").select(*keys)
    if tied.isEmpty():
        return out
    by = W.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return out.unionByName(df.join(small(tied, most), keys, "left_semi").withColumn("_delivery", F.row_number().over(by)).where("_delivery = 1").select(*df.columns))


def windows(text: Column, size: int | Column, overlap: int | Column) -> Column:
    """Non-empty windows of a normalized text: they start every size - overlap characters."""
    if not isinstance(size, Column):
        checked(size, overlap)
        size, overlap = F.lit(size), F.lit(overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), size - overlap)
    return F.filter(F.transform(starts, lambda s: strip(F.substring(text, s + 1, size))), lambda p: F.length(p) > 0)


def split_texts(df: DataFrame, key: str, column: str, size: int, overlap: int) -> DataFrame:
    """(key, piece, text), pieces counted from 1."""
    text = normalize_whitespace(F.col(column))
    return df.select(key, text.alias("_t")).select(key, F.posexplode(windows(F.col("_t"), size, overlap)).alias("piece", "text")).withColumn("piece", F.col("piece") + 1)


def with_parts(tables: DataFrame, size: int | Column) -> DataFrame:
    """Adds `parts_`: whole protected rows packed greedily into (text, row_start, row_end, row_count), caption and header repeated in each."""
    blank = F.lit("")
    line = lambda r: F.struct(normalize_whitespace(F.coalesce(r.text, blank)).alias("text"), r.row.alias("row"), F.coalesce(r.is_header, F.lit(False)).alias("head"))
    out = fence(tables.withColumn("lines_", F.transform("protected_rows", line)))
    out = fence(out.withColumn("heads_", F.filter("lines_", lambda r: r.head)).withColumn("data_", F.filter("lines_", lambda r: ~r.head)))
    prefix = F.array_join(F.filter(F.concat(F.array(normalize_whitespace(F.coalesce("caption", blank))), F.transform("heads_", lambda r: r.text)), lambda t: F.length(t) > 0), "\n")
    out = fence(out.withColumn("prefix_", prefix))
    part = lambda t, a, b, n: F.struct(t.alias("text"), a.cast("int").alias("row_start"), b.cast("int").alias("row_end"), n.cast("int").alias("row_count"))
    none = F.lit(None).cast("int")
    start = F.struct(F.array().cast("array<struct<text:string,row_start:int,row_end:int,row_count:int>>").alias("done"), F.col("prefix_").alias("now"), none.alias("a"), none.alias("b"), F.lit(0).alias("n"))
    glue = lambda x, y: F.when(F.length(x) > 0, F.concat(x, F.lit("\n"), y)).otherwise(y)

    def add(acc: Column, r: Column) -> Column:
        full = (acc.n > 0) & (F.length(acc.now) + 1 + F.length(r.text) > size)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(part(acc.now, acc.a, acc.b, acc.n)))).otherwise(acc.done).alias("done"),
            F.when(full, glue(F.col("prefix_"), r.text)).otherwise(glue(acc.now, r.text)).alias("now"),
            F.when(full, r.row).otherwise(F.least(acc.a, r.row)).alias("a"), F.when(full, r.row).otherwise(F.greatest(acc.b, r.row)).alias("b"), F.when(full, F.lit(1)).otherwise(acc.n + 1).alias("n"),
        )

    lines = F.filter("data_", lambda r: F.length(r.text) > 0)
    packed = F.aggregate(lines, start, add, lambda acc: F.when(F.length(acc.now) > 0, F.concat(acc.done, F.array(part(acc.now, acc.a, acc.b, acc.n)))).otherwise(acc.done))
    marks = F.filter(F.transform("heads_", lambda r: F.coalesce(r.row, F.lit(-1))), lambda n: n >= 0)
    only_head = F.array(part(F.col("prefix_"), F.array_min(marks), F.array_max(marks), F.size(marks)))
    whole = F.array(part(normalize_whitespace(F.coalesce("text", blank)), none, none, F.coalesce("rows", F.lit(0))))
    parts = F.when(F.coalesce(F.size("lines_"), F.lit(0)) <= 0, whole).when(F.size("data_") == 0, only_head).otherwise(packed)
    return fence(out.withColumn("parts_", F.filter(parts, lambda p: F.length(p.text) > 0)).drop("lines_", "heads_", "data_", "prefix_"))


SECTION = "struct<section_id:string,layout_type:string,layoutno:string,col_id:int,bbox:array<double>,box_ids:array<string>>"
CELLS = "array<struct<row:int,col:int,text:string,bbox:array<double>,is_header:boolean,row_span:int,col_span:int,text_box_ids:array<string>>>"
ROWS = "array<struct<row:int,text:string,is_header:boolean,cell_count:int,cell_ids:array<string>>>"
TABLE = f"struct<table_id:string,parent_table_id:string,part_index:int,part_count:int,rows:int,columns:int,row_start:int,row_end:int,row_count:int,bbox:array<double>,caption:string,html:string,source:string,cells:{CELLS},protected_rows:{ROWS},table_protection:string>"
METADATA = "struct<title:string,industry:string,doc_type:string,year_month:string,source_url:string,expected_pages:int,file_size_bytes:bigint,notes:string>"
PROTECTION = "row_boundary"
_ORDER = ("kind_ord", "ord")


def _fields(kind: str) -> dict[str, str]:
    """The fields of a struct type by name, read without a session."""
    out, depth, start, inner = {}, 0, 0, kind.removeprefix("struct<").removesuffix(">") + ","
    for at, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, what = inner[start:at].partition(":")
            out[name], start = what, at + 1
    return out


def _struct(given: dict[str, Column], kind: str) -> Column:
    """A struct of a type from some of its fields; the others are null."""
    return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _fields(kind).items()))


def _structs(column: Column, given: T.DataType, kind: str) -> Column:
    """An array of structs as one of structs of a type; fields that the given ones lack are null."""
    there = {f.name for f in given.elementType.fields}
    return F.transform(column, lambda x: _struct({n: x[n] for n in _fields(kind) if n in there}, kind))


def section_chunks(pages: DataFrame, size: int | Column, overlap: int | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of sections: chunk_id, doc_id, source, page, text, chunk_type, has_table, metadata, section_id, section (struct), and the columns of pages to keep."""
    one = pages.select(*keep, "doc_id", "source", "page", "metadata", F.posexplode("sections").alias("section_ord", "s"))
    fields = {f.name for f in one.schema["s"].dataType.fields}
    section_id = F.coalesce(F.nullif("s.section_id", F.lit("")), numbered(numbered(F.col("doc_id"), "p", F.col("page")), "s", F.col("section_ord") + 1))
    one = one.select("*", section_id.alias("section_id"), normalize_whitespace(F.coalesce("s.text", F.lit(""))).alias("_t"))
    cut = one.select("*", F.posexplode(windows(F.col("_t"), size, overlap)).alias("piece", "text"))
    section = _struct({"section_id": F.col("section_id")} | {n: F.col(f"s.{n}") for n in _fields(SECTION) if n in fields and n != "section_id"}, SECTION)
    return cut.select(
        *keep, numbered(F.col("section_id"), "c", F.col("piece") + 1).alias("chunk_id"), "doc_id", "source", "page", "text", F.coalesce(F.nullif("s.layout_type", F.lit("")), F.lit("text")).alias("chunk_type"), F.lit(False).alias("has_table"), "metadata", "section_id", section.alias("section"),
        F.lit(0).alias("kind_ord"), (F.col("section_ord") * 100000 + F.col("piece")).cast("bigint").alias("ord"),
    )


def fallback_chunks(pages: DataFrame, size: int | Column, overlap: int | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of the whole page, for pages none of whose sections has a text; the columns of section_chunks."""
    empty = pages.where(~F.coalesce(F.exists("sections", lambda s: F.length(normalize_whitespace(F.coalesce(s.text, F.lit("")))) > 0), F.lit(False)))
    cut = empty.select("*", normalize_whitespace(F.coalesce("text", F.lit(""))).alias("_t")).select("*", F.posexplode(windows(F.col("_t"), size, overlap)).alias("piece", "piece_text"))
    return cut.select(
        *keep, numbered(numbered(F.col("doc_id"), "p", F.col("page")), "c", F.col("piece") + 1).alias("chunk_id"), "doc_id", "source", "page", F.col("piece_text").alias("text"), F.lit("text").alias("chunk_type"), F.lit(False).alias("has_table"), "metadata",
        F.lit(None).cast("string").alias("section_id"), F.lit(None).cast(SECTION).alias("section"), F.lit(0).alias("kind_ord"), F.col("piece").cast("bigint").alias("ord"),
    )


def table_chunks(tables: DataFrame, size: int | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole rows of tables: chunk_id, table_id, doc_id, page, text, part numbers, and table (struct); pages' source and metadata are not known here."""
    parts = with_parts(tables, size)
    one = parts.select("*", F.size("parts_").alias("part_count"), F.posexplode("parts_").alias("_k", "_p"))
    given = {"parent_table_id": F.col("table_id"), "part_index": F.col("_k") + 1, "part_count": F.col("part_count"), "caption": F.coalesce("caption", F.lit("")), "table_protection": F.lit(PROTECTION)} | {n: F.col(f"_p.{n}") for n in ("row_start", "row_end", "row_count")}
    given |= {n: F.col(n) for n in _fields(TABLE) if n in tables.columns and n not in given}
    for name, kind in (("cells", CELLS), ("protected_rows", ROWS)):
        if name in given:
            given[name] = _structs(given[name], tables.schema[name].dataType, kind.removeprefix("array<").removesuffix(">"))
    return one.select(
        *keep, F.when(F.col("part_count") == 1, F.col("table_id")).otherwise(numbered(F.col("table_id"), "part", F.col("_k") + 1)).alias("chunk_id"), "doc_id", "page", F.col("_p.text").alias("text"), F.lit("table").alias("chunk_type"), F.lit(True).alias("has_table"),
        "table_id", (F.col("_k") + 1).alias("part_index"), "part_count", "_p.row_start", "_p.row_end", "_p.row_count", _struct(given, TABLE).alias("table"), F.lit(1).alias("kind_ord"), F.col("_k").cast("bigint").alias("ord"),
    )


def chunk_pages(pages: DataFrame, tables: DataFrame, size: int | Column = 512, overlap: int | Column = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """All chunks of all pages, without their structs: sections, else the page's text, then tables."""
    parts = [F.lit(None).cast("string" if c.endswith("_id") else "int").alias(c) for c in ("table_id", "part_index", "part_count", "row_start", "row_end", "row_count")]
    same = [*keep, "chunk_id", "doc_id", "page", "text", "chunk_type", "has_table", *_ORDER]
    text = section_chunks(pages, size, overlap, keep).unionByName(fallback_chunks(pages, size, overlap, keep)).select(*same, "section_id", *parts)
    return text.unionByName(table_chunks(tables, size, keep).select(*same, F.lit(None).cast("string").alias("section_id"), "table_id", "part_index", "part_count", "row_start", "row_end", "row_count"))


def nested_tables(pages: DataFrame) -> DataFrame:
    """The tables that pages hold in their column `tables`, with their page's source and metadata as page_source and metadata."""
    one = pages.select("doc_id", "page", F.col("source").alias("page_source"), "metadata", F.posexplode("tables").alias("_ord", "t"))
    table_id = F.coalesce(F.nullif("t.table_id", F.lit("")), numbered(numbered(F.col("doc_id"), "p", F.col("page")), "t", F.col("_ord") + 1))
    fields = [f.name for f in one.schema["t"].dataType.fields if f.name not in ("table_id", "page", "doc_id")]
    return one.select("doc_id", "page", "page_source", "metadata", table_id.alias("table_id"), *(F.col(f"t.{n}").alias(n) for n in fields))


def chunk_records(pages: DataFrame, tables: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """The records of all chunks: chunk_id, doc_id, source, pages, text, chunk_type, has_table, metadata, section and table (structs, one of them or none).

    tables are those of the pages (`nested_tables`, which know their page's source and metadata) or a table of their own,
    which takes both from the pages by a join of the narrow columns.
    """
    if "page_source" not in tables.columns:
        tables = tables.join(pages.select("doc_id", "page", F.col("source").alias("page_source"), "metadata"), ["doc_id", "page"], "left")
    text = section_chunks(pages, size, overlap).unionByName(fallback_chunks(pages, size, overlap))
    whole = lambda df, source, section, table: df.select("chunk_id", "doc_id", source.alias("source"), F.array("page").alias("pages"), "text", "chunk_type", "has_table", F.col("metadata").cast(METADATA).alias("metadata"), section.alias("section"), table.alias("table"), "page", *_ORDER)
    out = whole(text, F.col("source"), F.col("section"), F.lit(None).cast(TABLE)).unionByName(whole(table_chunks(tables, size, ("page_source", "metadata")), F.col("page_source"), F.lit(None).cast(SECTION), F.col("table")))
    return out.drop("page", *_ORDER)


def chunk_stats(chunks: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Counts and lengths of chunks, 0 where there is none. Chunks without a column table_protection are taken for protected."""
    protection = F.col("table_protection") if "table_protection" in chunks.columns else F.lit(PROTECTION)
    n = F.length(F.coalesce("text", F.lit("")))
    kind = lambda k: F.count_if(F.col("chunk_type") == k)
    return chunks.groupBy(*by).agg(
        F.countDistinct("doc_id").alias("doc_count"), F.count("*").alias("chunk_count"), kind("text").alias("text_chunks"), kind("title").alias("title_chunks"), kind("table").alias("table_chunks"), F.count_if("has_table").alias("has_table_count"),
        F.count_if(F.col("has_table") & (F.coalesce("part_count", F.lit(1)) > 1)).alias("split_table_chunks"), F.count_if(F.col("has_table") & ~F.coalesce(protection == PROTECTION, F.lit(False))).alias("missing_protection"), F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.median(n), F.lit(0.0)).alias("median_chars"), F.coalesce(F.max(n), F.lit(0)).alias("max_chars"),
        F.round(F.try_divide(F.count("*"), F.countDistinct("doc_id")), 6).alias("chunks_per_document"),
    )


def sweep(pages: DataFrame, tables: DataFrame, configs: Iterable[tuple[int, int]] = CONFIGS) -> DataFrame:
    """chunk_stats of every configuration, over one reading of pages and tables, each of which is taken once per configuration."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("chunk_size"), F.lit(b).alias("overlap")) for a, b in (checked(*c) for c in configs))))
    spread = lambda df: df.select("*", each.alias("_c")).select("*", "_c.*").drop("_c")
    chunks = chunk_pages(spread(pages), spread(tables), F.col("chunk_size"), F.col("overlap"), ("chunk_size", "overlap"))
    return chunk_stats(chunks, ["chunk_size", "overlap"])


def page_stats(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(what, name, n): pages, documents, pages by industry, tables and tables by source."""
    industry = F.coalesce(F.nullif("metadata.industry", F.lit("")), F.lit("未标注"))
    origin = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    row = lambda df, what: df.select(F.lit(what).alias("what"), "name", "n")
    return (
        row(pages.agg(F.count("*").alias("n")).withColumn("name", F.lit("all")), "pages")
        .unionByName(row(pages.agg(F.countDistinct("doc_id").alias("n")).withColumn("name", F.lit("all")), "documents"))
        .unionByName(row(pages.groupBy(industry.alias("name")).agg(F.count("*").alias("n")), "pages by industry"))
        .unionByName(row(tables.agg(F.count("*").alias("n")).withColumn("name", F.lit("all")), "tables"))
        .unionByName(row(tables.groupBy(origin.alias("name")).agg(F.count("*").alias("n")), "tables by source"))
    )


def inspect(chunks: DataFrame, keyword: str | None = None, doc_id: str | None = None, limit: int = 10) -> DataFrame:
    """The first chunks that hold a keyword (case counts) and belong to a document, by document and chunk id."""
    if keyword:
        chunks = chunks.where(F.col("text").contains(keyword))
    if doc_id:
        chunks = chunks.where(F.col("doc_id") == doc_id)
    return chunks.orderBy("doc_id", "chunk_id").limit(max(0, limit))


def report(stats: list, summary: list, source: str = "", outputs: dict[tuple[int, int], str] | None = None) -> str:
    """The comparison as Markdown, from the few collected rows of sweep() and page_stats(); outputs names each configuration's file of chunks."""
    of = {}
    for r in summary:
        of.setdefault(r.what, {})[r.name] = r.n
    listed = lambda what, empty: "，".join(f"{k}: {v}" for k, v in sorted(of.get(what, {}).items())) or empty
    lines = ["# Chunk parameters", "", *([f"- input: `{source}`"] if source else []), f"- documents: {of.get('documents', {}).get('all', 0)}", f"- pages: {of.get('pages', {}).get('all', 0)}", f"- tables: {of.get('tables', {}).get('all', 0)} ({listed('tables by source', '无')})", f"- pages by industry: {listed('pages by industry', '未标注')}", ""]
    lines += ["| size | overlap | chunks | average | median | longest | table chunks | of split tables | without row protection | Recall@5 | output |", "|---:|---:|---:|---:|---:|---:|---:|---:|---:|---|---|"]
    lines += [f"| {r.chunk_size} | {r.overlap} | {r.chunk_count} | {r.avg_chars} | {r.median_chars} | {r.max_chars} | {r.table_chunks} | {r.split_table_chunks} | {r.missing_protection} | not measured | {(outputs or {}).get((r.chunk_size, r.overlap), '-')} |" for r in stats]
    return "\n".join(lines) + "\n"
