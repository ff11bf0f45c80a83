"""Catalogue of documents: manifest records, files found, their union and differences, and validation.

Paths are compared in full (`resolved`), relative ones standing for files under the root. Defined results: null fields
are empty texts; records without a path are dropped; a record without an id gets one made of its file's name; pages that
are no whole number are null.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import resolved, stable_id, strip, to_int, under

FIELDS = ("title", "industry", "doc_type", "year_month", "source_url", "notes")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def manifest_records(rows: DataFrame, root: str = "/") -> DataFrame:
    """Cleaned records: doc_id, file_path, the text fields, expected_pages, file_size_bytes, resolved."""
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    path = text("file_path")
    return rows.where(F.length(path) > 0).select(
        F.coalesce(F.nullif(text("doc_id"), F.lit("")), stable_id(stem(path))).alias("doc_id"), path.alias("file_path"), *(text(c).alias(c) for c in FIELDS),
        to_int(F.coalesce(F.col("pages").cast("string"), F.lit(""))).alias("expected_pages"), strip(F.coalesce(F.col("file_size_bytes").cast("string"), F.lit(""))).try_cast("bigint").alias("file_size_bytes"), resolved(path, root).alias("resolved"),
    )


def metadata(records: DataFrame) -> DataFrame:
    """(doc_id, source, metadata): what pages and chunks say of their document, once per id (of several records the first path's)."""
    said = F.struct(*(F.col(c) for c in ("title", "industry", "doc_type", "year_month", "source_url", "expected_pages", "file_size_bytes", "notes")))
    return records.groupBy("doc_id").agg(F.min_by(F.struct(F.col("file_path").alias("source"), said.alias("metadata")), "file_path").alias("x")).select("doc_id", "x.*")


def discovered_records(files: DataFrame, raw_dir: str, root: str = "/") -> DataFrame:
    """Records of files (path, length) under raw_dir, in the columns of manifest_records: the first folder is the industry, the name the title."""
    full = resolved(F.col("path"), root)
    inner = under(full, posixpath.normpath(posixpath.join(root, raw_dir)))
    empty = F.lit("")
    texts = {"title": stem(full), "industry": F.when(inner.contains("/") & ~inner.startswith("/"), F.substring_index(inner, "/", 1)).otherwise(empty), "doc_type": F.lit("pdf")}
    return files.select(
        stable_id(stem(full)).alias("doc_id"), under(full, root).alias("file_path"), *(texts.get(c, empty).alias(c) for c in FIELDS),
        F.lit(None).cast("int").alias("expected_pages"), F.col("length").cast("bigint").alias("file_size_bytes"), full.alias("resolved"),
    )


def unlisted(found: DataFrame, listed: DataFrame) -> DataFrame:
    return found.join(listed.select("resolved"), "resolved", "left_anti")


def missing(listed: DataFrame, found: DataFrame) -> DataFrame:
    return listed.join(found.select("resolved"), "resolved", "left_anti")


def documents(listed: DataFrame, found: DataFrame, include_unlisted: bool = True) -> DataFrame:
    """Listed records and, if wanted, files that are not listed; of both those that exist."""
    there = listed.join(found.select("resolved"), "resolved", "left_semi").select(*listed.columns)
    return there.unionByName(unlisted(found, listed).select(*listed.columns)) if include_unlisted else there


def duplicates(records: DataFrame) -> DataFrame:
    """(kind, value, n) of ids, and of paths in full, listed more than once."""
    one = lambda kind, c: records.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "value", "n")
    return one("doc_id", "doc_id").unionByName(one("file_path", "resolved"))


def by_group(records: DataFrame, found: DataFrame) -> DataFrame:
    """(grouping, name, files, pages, bytes, no_pages) by industry and by kind; bytes are those of files that exist."""
    sized = records.join(found.groupBy("resolved").agg(F.max("file_size_bytes").alias("found_bytes")), "resolved", "left")

    def one(c: str) -> DataFrame:
        name = F.coalesce(F.nullif(c, F.lit("")), F.lit("(empty)"))
        sums = F.coalesce(F.sum("expected_pages"), F.lit(0)).cast("bigint").alias("pages"), F.coalesce(F.sum("found_bytes"), F.lit(0)).cast("bigint").alias("bytes")
        return sized.groupBy(name.alias("name")).agg(F.count("*").alias("files"), *sums, F.count_if(F.col("expected_pages").isNull()).alias("no_pages")).select(F.lit(c).alias("grouping"), "name", "files", "pages", "bytes", "no_pages")

    return one("industry").unionByName(one("doc_type"))


def validation(records: DataFrame, found: DataFrame) -> DataFrame:
    """One row: numbers of records, files and of each problem, and the status (FAIL if there is any)."""
    of = lambda df, name: df.agg(F.count("*").alias(name))
    twice = duplicates(records)
    out = of(records, "manifest_records").crossJoin(of(found, "raw_files")).crossJoin(of(twice.where("kind = 'doc_id'"), "duplicate_doc_ids")).crossJoin(of(twice.where("kind = 'file_path'"), "duplicate_paths"))
    out = out.crossJoin(of(missing(records, found), "missing_paths")).crossJoin(of(unlisted(found, records), "unlisted_files"))  # single rows
    return out.withColumn("status", F.when(F.col("duplicate_doc_ids") + F.col("duplicate_paths") + F.col("missing_paths") + F.col("unlisted_files") > 0, "FAIL").otherwise("OK"))
