"""Sources and sinks: JSONL, manifests, files on disk, text boxes of documents, vector indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX_SCHEMA = "doc_id string, page int, page_width double, page_height double, box_ord int, box_id string, text string, x0 double, top double, x1 double, bottom double, font_size double, block_no int, line_no int, source string"
MANIFEST = ("doc_id", "file_path", "title", "industry", "doc_type", "year_month", "source_url", "pages", "file_size_bytes", "notes")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped, a broken line is an error."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> int:
    """One record a line, nulls kept; the number of records."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV manifest as texts; absent columns are null, quotes are doubled inside quotes, a leading mark is dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    return raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST))


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length) of the files below a folder; the contents are not read. The case of the pattern counts."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def _documents(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def text_boxes(spark: SparkSession, folder: str, extract: Callable[[str, bytes], Iterator[tuple]], pattern: str = "*.pdf") -> DataFrame:
    """Text boxes of documents by a pluggable extractor: extract(path, content) yields rows of BOX_SCHEMA; path is added to each.

    A page without boxes is a row without a box_id. A file that cannot be read gives one row with its path as id, no
    page, and the error as its text.
    """
    names = [x.split()[0] for x in BOX_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in BOX_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = list(extract(path, content))
                except Exception as error:  # noqa: BLE001 - whatever the extractor raises belongs to this file alone
                    rows = [(path, None, None, None, None, None, str(error), *[None] * 7, "error")]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows), pa.string())], [*names, "path"])

    return _documents(spark, folder, pattern).mapInArrow(run, f"{BOX_SCHEMA}, path string")


def drawn_tables(spark: SparkSession, folder: str, extract: Callable[[str, bytes], Iterator[tuple]], pattern: str = "*.pdf") -> DataFrame:
    """(path, page, ord, caption, bbox, source, cells) of tables drawn with lines by a pluggable extractor: extract(path, content) yields (page, bbox, cells).

    cells are (row, col, text, bbox); bbox may be None for tables of which only the rows are known. A page's tables are
    numbered in the order they come. A file on which the extractor fails has the tables that came before the failure.
    """
    cell = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("is_header", pa.bool_()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("text_box_ids", pa.list_(pa.string()))])
    types = {"path": pa.string(), "page": pa.int32(), "ord": pa.int32(), "caption": pa.string(), "bbox": pa.list_(pa.float64()), "source": pa.string(), "cells": pa.list_(cell)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen = [], {}
                try:
                    for page, bbox, cells in extract(path, content):
                        seen[page] = n = seen.get(page, 0) + 1
                        made = [dict(zip(("row", "col", "text", "bbox", "is_header", "row_span", "col_span", "text_box_ids"), (*c, None, 1, 1, []))) for c in cells]
                        rows.append((path, page, n, "", bbox, "pdfplumber_structured", made))
                except Exception:  # noqa: BLE001 - tables are an extra: their failure leaves the text
                    pass
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))

    cells = "array<struct<row:int,col:int,text:string,bbox:array<double>,is_header:boolean,row_span:int,col_span:int,text_box_ids:array<string>>>"
    return _documents(spark, folder, pattern).mapInArrow(run, f"path string, page int, ord int, caption string, bbox array<double>, source string, cells {cells}")


def save_index(chunks: DataFrame, path: str) -> None:
    """Vectors and what they stand for in one table, so that they cannot get out of step."""
    chunks.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
