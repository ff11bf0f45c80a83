"""Structure of tables: matrix, header rows, column headers, row texts, spans, HTML and Markdown.

A table is a row with an array of cells (row, col, text, ...); everything is array functions over it, so no
table is taken apart and shuffled. Defined results: null texts and cells count as blank; blank rows are
dropped but the other rows keep their numbers; of two cells in one place the last counts; a table without
cells gives an empty matrix, no rows and an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkstone.functions.geometry import center_inside, overlap_ratio, round_bbox
from inkstone.functions.text import html_escape, normalize_whitespace, numeric_like
from inkstone.session import fence

CELL = "struct<row:int,col:int,text:string,bbox:array<double>,is_header:boolean,row_span:int,col_span:int,text_box_ids:array<string>>"
LINES = "array<struct<row:int,own:array<struct<row:int,col:int,text:string>>>>"


def with_matrix(tables: DataFrame) -> DataFrame:
    """Adds `columns_` and `matrix_`: (row, texts) of the rows that are not blank, padded to one width."""
    cell = lambda c: F.struct(c.row.alias("row"), c.col.alias("col"), normalize_whitespace(F.coalesce(c.text, F.lit(""))).alias("text"))
    cells = F.transform(F.filter(F.coalesce("cells", F.array().cast(f"array<{CELL}>")), lambda c: c.row.isNotNull() & c.col.isNotNull()), cell)
    out = fence(fence(tables.withColumn("cells_", cells)).withColumn("columns_", F.coalesce(F.array_max(F.transform("cells_", lambda c: c.col)) + 1, F.lit(0))))
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter("cells_", lambda c: F.length(c.text) > 0), lambda c: c.row)))
    lines = F.transform(numbers, lambda r: F.struct(r.alias("row"), F.filter("cells_", lambda c: c.row == r).alias("own")))  # a row's cells are picked once

    def line(r: Column) -> Column:
        texts = F.transform(F.sequence(F.lit(0), F.col("columns_") - 1), lambda k: F.coalesce(F.try_element_at(F.filter(r.own, lambda c: c.col == k), F.lit(-1)).text, F.lit("")))
        return F.struct(r.row.alias("row"), texts.alias("texts"))

    out = fence(out.withColumn("lines_", F.when(F.col("columns_") > 0, lines).otherwise(F.array().cast(LINES))))
    return fence(out.withColumn("matrix_", F.transform("lines_", line)).drop("lines_"))


def with_headers(matrices: DataFrame, given: Column | None = None) -> DataFrame:
    """Adds `header_rows_` (the first row, and the second if at least 60 % of its filled cells are no numbers; or those given) and `headers_`: (col, text)."""

    def worded(line: Column) -> Column:
        filled = F.filter(line.texts, lambda t: F.length(t) > 0)
        return F.size(F.filter(filled, lambda t: ~numeric_like(t))) / F.greatest(F.size(filled), F.lit(1)) >= 0.6

    first, second = F.slice("matrix_", 1, 1), F.filter(F.slice("matrix_", 2, 1), worded)
    out = fence(matrices.withColumn("header_rows_", F.transform(F.concat(first, second), lambda r: r.row) if given is None else given))
    out = fence(out.withColumn("heads_", F.filter("matrix_", lambda r: F.array_contains("header_rows_", r.row))))
    texts = F.transform(F.sequence(F.lit(0), F.greatest(F.col("columns_") - 1, F.lit(0))), lambda k: F.struct(k.cast("int").alias("col"), F.array_join(F.filter(F.transform("heads_", lambda r: F.try_element_at(r.texts, k + 1)), lambda t: F.length(t) > 0), "的").alias("text")))
    return fence(out.withColumn("headers_", F.filter(texts, lambda h: F.length(h.text) > 0)).drop("heads_"))


def with_rows(headed: DataFrame) -> DataFrame:
    """Adds `rows_`: (row, text, is_header, cell_count, cell_ids) of every row of the matrix, as one line of text each."""
    caption = F.coalesce("caption", F.lit(""))

    def line(r: Column) -> Column:
        head = F.array_contains("header_rows_", r.row)
        filled = F.filter(F.transform(r.texts, lambda t, k: F.struct(k.alias("col"), t.alias("text"))), lambda c: F.length(c.text) > 0)
        named = F.transform(filled, lambda c: F.concat(F.coalesce(F.concat(F.try_element_at(F.filter("headers_", lambda h: h.col == c.col), F.lit(1)).text, F.lit(": ")), F.lit("")), c.text))
        note = F.when((F.length(caption) > 0) & (F.size(filled) > 0), F.concat(F.lit("\t-- 来自「"), caption, F.lit("」"))).otherwise(F.lit(""))
        text = F.concat(F.array_join(named, "; "), note)
        own = F.array_sort(F.transform(F.filter("cells_", lambda c: c.row == r.row), lambda c: c.col))
        return F.struct(
            r.row.alias("row"), normalize_whitespace(F.when(head, F.array_join(F.transform(filled, lambda c: c.text), " | ")).otherwise(text)).alias("text"), head.alias("is_header"),
            F.size(own).alias("cell_count"), F.transform(own, lambda k: F.concat(F.lit("r"), r.row.cast("string"), F.lit("c"), k.cast("string"))).alias("cell_ids"),
        )

    return fence(headed.withColumn("rows_", F.transform("matrix_", line)))


def markdown(caption: Column, matrix: Column, columns: Column) -> Column:
    line = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    lines = F.transform(matrix, lambda r: line(r.texts))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), columns), " | "), F.lit(" |"))
    top = F.when(F.length(F.coalesce(caption, F.lit(""))) > 0, F.array(caption)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(matrix) == 0, F.lit("")).otherwise(F.array_join(F.concat(top, F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n"))


def html(caption: Column, matrix: Column, header_rows: Column, cells: Column) -> Column:
    """The table as HTML, by the places that hold a cell; of two cells in one place the last counts."""
    span = lambda name, n: F.when(F.coalesce(n, F.lit(1)) > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise(F.lit(""))

    def place(tag: Column, t: Column, own: Column) -> Column:
        return F.when(own.isNotNull(), F.concat(F.lit("<"), tag, span("colspan", own.col_span), span("rowspan", own.row_span), F.lit(">"), html_escape(t), F.lit("</"), tag, F.lit(">")))

    def line(r: Column) -> Column:
        texts = F.transform(r.texts, lambda t, k: place(r.tag, t, F.try_element_at(F.filter(r.own, lambda c: c.col == k), F.lit(-1))))
        return F.concat(F.array(F.lit("<tr>")), F.filter(texts, lambda x: x.isNotNull()), F.array(F.lit("</tr>")))

    tag = lambda r: F.when(F.array_contains(header_rows, r.row), F.lit("th")).otherwise(F.lit("td"))
    lines = F.transform(matrix, lambda r: F.struct(r.texts.alias("texts"), tag(r).alias("tag"), F.filter(cells, lambda c: c.row == r.row).alias("own")))
    top = F.when(F.length(F.coalesce(caption, F.lit(""))) > 0, F.array(F.lit("<table>"), F.concat(F.lit("<caption>"), html_escape(caption), F.lit("</caption>")))).otherwise(F.array(F.lit("<table>")))
    return F.array_join(F.concat(top, F.flatten(F.transform(lines, line)), F.array(F.lit("</table>"))), "\n")


def structured(tables: DataFrame, describe: bool = True) -> DataFrame:
    """Tables with matrix, headers, row texts, and `text_`: Markdown, followed by the description of each row if wanted (tables made of bare rows have none)."""
    return _described(with_rows(with_headers(with_matrix(tables))), describe)


def _described(out: DataFrame, describe: bool) -> DataFrame:
    marked = markdown(F.col("caption"), F.col("matrix_"), F.col("columns_"))
    lines = F.array_join(F.filter(F.transform("rows_", lambda r: r.text), lambda t: F.length(t) > 0), "\n") if describe else F.lit("")
    return fence(out.withColumn("markdown_", marked)).withColumn("text_", F.when(F.length(lines) > 0, normalize_whitespace(F.concat("markdown_", F.lit("\n\n行级描述:\n"), lines))).otherwise(normalize_whitespace(F.col("markdown_"))))


RECORD = ("table_id", "doc_id", "page", "text", "rows", "columns", "bbox", "caption", "html", "source", "cells", "protected_rows")


def records(tables: DataFrame, describe: bool = True) -> DataFrame:
    """Whole records (RECORD) of tables with cells; cells say whether they are in a header row."""
    t = structured(tables, describe)
    cells = F.transform("cells", lambda c: c.withField("is_header", F.array_contains("header_rows_", c.row)))
    return t.select(
        "table_id", "doc_id", "page", F.col("text_").alias("text"), F.size("matrix_").alias("rows"), F.col("columns_").alias("columns"), round_bbox(F.col("bbox")).alias("bbox"), F.coalesce("caption", F.lit("")).alias("caption"),
        html(F.col("caption"), F.col("matrix_"), F.col("header_rows_"), F.col("cells")).alias("html"), "source", cells.alias("cells"), F.col("rows_").alias("protected_rows"),
    )


def from_geometry(tables: DataFrame, boxes: DataFrame) -> DataFrame:
    """Whole records of tables drawn with lines: cells without a bbox are none, empty cells take the text of the boxes in them, spans follow from the bboxes.

    The Markdown shows the cells as they were drawn, rows' descriptions and HTML the filled ones.
    """
    drawn = tables.withColumn("cells", F.filter(F.coalesce("cells", F.array().cast(f"array<{CELL}>")), lambda c: (F.size(c.bbox) == 4) & c.row.isNotNull() & c.col.isNotNull()))
    filled = cell_boxes(drawn, boxes).select("table_id", "row", "col", F.col("text").alias("filled"), "ids").join(spans(drawn), ["table_id", "row", "col"])
    cell = F.struct("row", "col", F.struct("filled", "ids", "row_span", "col_span").alias("x"))
    known = filled.groupBy("table_id").agg(F.array_sort(F.collect_list(cell)).alias("known"))  # the cells of one table
    out = with_headers(with_matrix(drawn))
    out = out.withColumn("markdown_", markdown(F.col("caption"), F.col("matrix_"), F.col("columns_"))).select(*tables.columns, "markdown_", "header_rows_", F.transform("matrix_", lambda r: r.row).alias("shown"))
    out = fence(out.join(known, "table_id", "left"))
    of = lambda c: F.try_element_at(F.filter("known", lambda x: (x.row == c.row) & (x.col == c.col)), F.lit(1)).x
    told = F.transform("cells", lambda c: F.struct(c.alias("c"), of(c).alias("x")))
    cells = F.transform(told, lambda y: F.struct(y.c.row.alias("row"), y.c.col.alias("col"), F.coalesce(y.x.filled, F.lit("")).alias("text"), round_bbox(y.c.bbox).alias("bbox"), F.array_contains("header_rows_", y.c.row).alias("is_header"), y.x.row_span.alias("row_span"), y.x.col_span.alias("col_span"), y.x.ids.alias("text_box_ids")))
    out = fence(out.withColumn("cells", F.filter(cells, lambda c: F.array_contains("shown", c.row))))
    out = with_rows(with_headers(with_matrix(out), F.col("header_rows_")))
    lines = F.array_join(F.filter(F.transform("rows_", lambda r: r.text), lambda t: F.length(t) > 0), "\n")
    text = F.when(F.length(lines) > 0, F.concat("markdown_", F.lit("\n\n行级描述:\n"), lines)).otherwise(F.col("markdown_"))
    return out.select(
        "table_id", "doc_id", "page", normalize_whitespace(text).alias("text"), F.size("shown").alias("rows"), F.col("columns_").alias("columns"), round_bbox(F.col("bbox")).alias("bbox"), F.coalesce("caption", F.lit("")).alias("caption"),
        html(F.col("caption"), F.col("matrix_"), F.col("header_rows_"), F.col("cells")).alias("html"), "source", "cells", F.col("rows_").alias("protected_rows"),
    )


def spans(tables: DataFrame) -> DataFrame:
    """(table_id, row, col, row_span, col_span): over how many rows' and columns' middles a cell with a bbox reaches, at least 1.

    A row or column is as wide as what its cells have in common, so cells over several do not widen it.
    """
    boxed = F.transform(F.filter("cells", lambda c: F.size(c.bbox) == 4), lambda c: F.struct(c.row.alias("row"), c.col.alias("col"), round_bbox(c.bbox).alias("bbox")))

    def bands(key: str, lo: int, hi: int) -> Column:
        numbers = F.array_distinct(F.transform("b", lambda c: c[key]))
        return F.transform(numbers, lambda n: F.struct(F.array_max(F.transform(F.filter("b", lambda c: c[key] == n), lambda c: c.bbox[lo])).alias("a"), F.array_min(F.transform(F.filter("b", lambda c: c[key] == n), lambda c: c.bbox[hi])).alias("z")))

    out = fence(fence(tables.select("table_id", boxed.alias("b"))).select("table_id", "b", bands("row", 1, 3).alias("by_row"), bands("col", 0, 2).alias("by_col"))).select("table_id", "by_row", "by_col", F.explode("b").alias("c"))
    reach = lambda name, lo, hi: F.greatest(F.lit(1), F.size(F.filter(name, lambda x: center_inside(x.a, x.z, F.col("c.bbox")[lo], F.col("c.bbox")[hi]))))
    return out.select("table_id", "c.row", "c.col", reach("by_row", 1, 3).alias("row_span"), reach("by_col", 0, 2).alias("col_span"))


FOUND = "array<struct<top:double,x0:double,box_id:string,text:string,x1:double,bottom:double>>"


def cell_boxes(tables: DataFrame, boxes: DataFrame, least: float = 0.45) -> DataFrame:
    """(table_id, row, col, box_ids, ids, text): boxes of the page that lie in a cell, in reading order, as one text and as an array; their text fills an empty cell.

    A page's cells meet its boxes within the page's row, so neither is copied for the other.
    """
    per_page = boxes.where("text is not null").groupBy("doc_id", "page").agg(F.collect_list(F.struct("top", "x0", "box_id", "text", "x1", "bottom")).alias("boxes"))  # the boxes of one page
    cells = tables.select("table_id", "doc_id", "page", F.explode("cells").alias("c")).where(F.size("c.bbox") == 4).select("table_id", "doc_id", "page", "c.row", "c.col", "c.text", "c.bbox")
    joined = fence(cells.groupBy("doc_id", "page").agg(F.collect_list(F.struct("table_id", "row", "col", "text", "bbox")).alias("cells")).join(per_page, ["doc_id", "page"], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(FOUND))))
    found = lambda c: F.array_sort(F.filter("boxes", lambda b: overlap_ratio(b, c.bbox) >= least))
    held = F.transform("cells", lambda c: F.struct(c.table_id.alias("table_id"), c.row.alias("row"), c.col.alias("col"), c.text.alias("own"), F.transform(found(c), lambda b: F.struct(b.box_id.alias("box_id"), b.text.alias("text"))).alias("found")))
    rows = fence(joined.select(F.explode(held).alias("c")).select("c.*"))
    own, ids = normalize_whitespace(F.coalesce("own", F.lit(""))), F.transform("found", lambda b: b.box_id)
    return rows.select("table_id", "row", "col", F.array_join(ids, ",").alias("box_ids"), ids.alias("ids"), F.when(F.length(own) > 0, own).otherwise(normalize_whitespace(F.array_join(F.transform("found", lambda b: b.text), " "))).alias("text"))


def page_ranges(tables: DataFrame) -> DataFrame:
    """(table_id, doc_id, pages, parts): tables that go on over pages, by their first part; pages and parts are arrays in order.

    A table goes on if it is the last of its page (by id), the next page's first one has the same header row and as many
    columns, and that row is not blank.
    """
    head = F.transform(F.array_sort(F.transform(F.filter("cells", lambda c: (c.row == 0) & c.col.isNotNull()), lambda c: F.struct(c.col.alias("col"), normalize_whitespace(F.coalesce(c.text, F.lit(""))).alias("text")))), lambda c: c.text)
    told = fence(tables.select("table_id", "doc_id", "page", F.coalesce("columns", F.lit(-1)).alias("columns"), F.array_join(head, "|").alias("head")))
    page = W.partitionBy("doc_id", "page")
    told = told.withColumn("first", F.col("table_id") == F.min("table_id").over(page)).withColumn("last", F.col("table_id") == F.max("table_id").over(page))
    same = W.partitionBy("doc_id", "head", "columns").orderBy("page", "table_id")
    on = (F.col("page") == F.lag("page").over(same) + 1) & F.col("first") & F.lag("last").over(same) & (F.regexp_replace("head", r"[|\s]", "") != "")
    runs = told.withColumn("new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(same))
    one = runs.groupBy("doc_id", "head", "columns", "run").agg(F.array_sort(F.collect_list(F.struct("page", "table_id"))).alias("all"))  # the parts of one table
    return one.select(F.col("all")[0].table_id.alias("table_id"), "doc_id", F.transform("all", lambda x: x.page).alias("pages"), F.transform("all", lambda x: x.table_id).alias("parts"))
