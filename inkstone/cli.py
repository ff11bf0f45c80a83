"""Command line: python -m inkstone.cli COMMAND ...; every command is a thin layer over the operators."""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import numbered, preview, strip, under
from inkstone.operators import catalog, chunking, layout, retrieval, tables
from inkstone.session import local_session, materialize, ship
from inkstone.sources import files

TABLE = f"struct<table_id:string,page:int,text:string,rows:int,columns:int,bbox:array<double>,caption:string,html:string,source:string,cells:{chunking.CELLS},protected_rows:{chunking.ROWS}>"
PAGE = f"""doc_id string, source string, page int, text string, metadata {chunking.METADATA}, tables array<{TABLE}>,
 sections array<struct<section_id:string,page:int,text:string,layout_type:string,layoutno:string,col_id:int,bbox:array<double>,box_ids:array<string>>>"""
CHUNK = f"chunk_id string, doc_id string, source string, pages array<int>, text string, chunk_type string, has_table boolean, metadata {chunking.METADATA}, section {chunking.SECTION}, table {chunking.TABLE}"


def _place(a: argparse.Namespace, path: str) -> str:
    """A path given on the command line stands under the root."""
    return path if "://" in path else os.path.join(os.path.abspath(a.root), path)


def _load(name: str) -> Callable:
    """A function given as module:function; its module goes along to the workers."""
    module, _, function = name.partition(":")
    held = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(held)
    return getattr(held, function)


def _catalogue(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The listed records (none if there is no manifest) and the files found."""
    root, path = os.path.abspath(a.root), _place(a, a.manifest)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        rows = files.read_manifest(spark, path)
    else:
        rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in files.MANIFEST))
    return catalog.manifest_records(rows, root), catalog.discovered_records(files.find_files(spark, _place(a, a.raw_dir)), a.raw_dir, root)


def parse(spark: SparkSession, a: argparse.Namespace) -> str:
    """Documents -> pages. Extractors are module:function(path, content): rows of text boxes, and of tables drawn with lines."""
    listed, found = _catalogue(spark, a)
    kept = catalog.documents(listed, found, not a.manifest_only)
    if a.limit:
        kept = kept.orderBy("doc_id").limit(a.limit)
    kept = materialize(kept)
    raw, known = _place(a, a.raw_dir), kept.select(F.col("resolved").alias("path"), F.col("doc_id").alias("listed_id"))
    given = materialize(files.text_boxes(spark, raw, _load(a.extractor)).join(known, "path"))  # a document's id is that of its record
    errors = given.where("page is null").select("path", "text").orderBy("path").collect() if a.show_errors else []
    boxes = given.where("page is not null").withColumn("doc_id", F.col("listed_id")).drop("path", "listed_id")
    drawn = files.drawn_tables(spark, raw, _load(a.tables)) if a.tables else spark.createDataFrame([], f"path string, page int, ord int, caption string, bbox array<double>, source string, cells {chunking.CELLS}")
    drawn = drawn.join(known, "path").withColumnRenamed("listed_id", "doc_id").withColumn("table_id", numbered(numbered(F.col("doc_id"), "p", F.col("page")), "t", F.col("ord"))).drop("path", "ord")
    real = boxes.where("box_id is not null")
    boxed = materialize(tables.from_geometry(drawn.where("bbox is not null"), real).unionByName(tables.records(drawn.where("bbox is null"), describe=False)).where("text <> ''"))
    whole = boxed.unionByName(tables.records(layout.detected_tables(real, boxed)))
    return f"documents: {kept.count()}\npages: {files.write_jsonl(layout.page_records(boxes, materialize(whole), catalog.metadata(kept)), _place(a, a.output))}" + "".join(f"\nerror: {r.path}: {r.text}" for r in errors)


def _pages(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    pages = files.read_jsonl(spark, _place(a, a.input), PAGE)
    return pages.drop("tables"), chunking.nested_tables(pages)


def build_chunks(spark: SparkSession, a: argparse.Namespace) -> str:
    """Pages -> chunks."""
    return f"chunks: {files.write_jsonl(chunking.chunk_records(*_pages(spark, a), a.chunk_size, a.overlap), _place(a, a.output))}"


def _config(a: argparse.Namespace) -> retrieval.EncoderConfig:
    named = {"model_name": a.model} if a.model else {}
    return retrieval.EncoderConfig(load=_load(a.loader) if a.loader else None, batch_size=a.batch_size, max_length=a.max_length, normalize=not a.no_normalize, use_fp16=a.use_fp16, **named)


def build_index(spark: SparkSession, a: argparse.Namespace) -> str:
    """Chunks -> vectors, stored with what they stand for; --meta-path also writes the chunks by themselves."""
    chunks = files.read_jsonl(spark, _place(a, a.chunks), CHUNK).where(F.length(strip(F.col("text"))) > 0)
    if a.limit:
        chunks = chunks.orderBy("chunk_id").limit(a.limit)
    if chunks.isEmpty():
        raise SystemExit("no chunks")
    files.save_index(retrieval.encoded(chunks.withColumn("id", F.xxhash64("chunk_id")), "text", _config(a)), _place(a, a.index_path))
    index = files.load_index(spark, _place(a, a.index_path))
    if a.meta_path:
        files.write_jsonl(index.drop("embedding", "id"), _place(a, a.meta_path))
    return f"chunks: {index.count()}\ndimension: {retrieval.same_size(index)}"


def search(spark: SparkSession, a: argparse.Namespace) -> str:
    """The chunks nearest to a query."""
    index = files.load_index(spark, _place(a, a.index_path))
    asked = retrieval.encoded(spark.createDataFrame([(0, a.query)], "query_id bigint, query string"), "query", _config(a), queries=True)
    hits = retrieval.vector_topk(index, asked, a.top_k).join(index.drop("embedding"), "id").orderBy("rank").withColumn("shown", preview(F.col("text"), 700)).collect()
    return "\n".join([*(f"[{r.rank}] {r.score:.4f} {r.doc_id} p.{','.join(map(str, r.pages or []))} {r.chunk_id} ({r.chunk_type}) {r.source or ''} {(r.metadata and r.metadata.title) or ''}\n{r.shown}" for r in hits), f"matched: {len(hits)}"])


def experiment(spark: SparkSession, a: argparse.Namespace) -> str:
    """Statistics of chunks at several sizes, as a report; --output-dir also writes each configuration's chunks."""
    pages, found = _pages(spark, a)
    if pages.isEmpty():
        raise SystemExit("no pages")
    configs = [chunking.parse_config(c) for c in a.config] if a.config else chunking.CONFIGS
    outputs = {c: f"{a.output_dir}/chunks_{c[0]}_{c[1]}.jsonl" for c in configs} if a.output_dir else {}
    for (size, overlap), path in outputs.items():
        files.write_jsonl(chunking.chunk_records(pages, found, size, overlap), _place(a, path))
    text = chunking.report(chunking.sweep(pages, found, configs).orderBy("chunk_size", "overlap").collect(), chunking.page_stats(pages, found).collect(), a.input, outputs)
    os.makedirs(os.path.dirname(_place(a, a.report)), exist_ok=True)
    with open(_place(a, a.report), "w", encoding="utf-8") as out:
        out.write(text)
    return text


def inspect(spark: SparkSession, a: argparse.Namespace) -> str:
    """The first chunks with a keyword or of a document."""
    rows = chunking.inspect(files.read_jsonl(spark, _place(a, a.chunks), CHUNK), a.keyword, a.doc_id, a.limit).withColumn("shown", preview(F.col("text"), 600)).collect()
    return "\n".join([*(f"{r.chunk_id}: {r.doc_id} p.{','.join(map(str, r.pages or []))} {r.chunk_type} table={r.has_table} {r.source or ''} {(r.metadata and r.metadata.title) or ''}\n{r.shown}" for r in rows), f"matched: {len(rows)}"])


def validate(spark: SparkSession, a: argparse.Namespace) -> str:
    """Checks a manifest against the files; ends with an error if there is any problem."""
    listed, found = (materialize(x) for x in _catalogue(spark, a))
    totals = catalog.validation(listed, found).first()
    lines = [f"manifest_records: {totals.manifest_records}", f"raw_files: {totals.raw_files}", f"missing_page_count: {listed.where('expected_pages is null').count()}"]
    lines += [f"{r.grouping} {r.name}: files={r.files} pages={r.pages} size_mb={r.bytes / 1024 / 1024:.1f}" for r in catalog.by_group(listed, found).orderBy("grouping", "name").collect()]
    twice, root = catalog.duplicates(listed), os.path.abspath(a.root)
    for title, df in (("duplicate_doc_ids", twice.where("kind = 'doc_id'").select("value")), ("duplicate_paths", twice.where("kind = 'file_path'").select(under(F.col("value"), root))), ("missing_paths", catalog.missing(listed, found).select(under(F.col("resolved"), root))), ("unlisted_files", catalog.unlisted(found, listed).select(under(F.col("resolved"), root)))):
        df = df.toDF("x")
        examples, n = [r.x for r in df.orderBy("x").limit(a.show).collect()], df.count()
        lines += [f"{title}: {n}", *(f"  - {x}" for x in examples), *([f"  ... {n - len(examples)} more"] if n > len(examples) else [])]
    text = "\n".join([*lines, f"status: {totals.status}"])
    if totals.status == "FAIL":
        raise SystemExit(text)
    return text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkstone", description=__doc__)
    commands = top.add_subparsers(required=True)

    def add(name: str, run, *options: tuple) -> None:
        one = commands.add_parser(name, help=run.__doc__)
        one.set_defaults(run=run)
        for flag, default in (*options, ("--root", ".")):
            if default is False:
                one.add_argument(flag, action="store_true")
            elif default == []:
                one.add_argument(flag, action="append", default=[])
            else:
                one.add_argument(flag, default=default, type=type(default) if default is not None and default is not ... else str, required=default is ...)

    model = (("--loader", None), ("--model", None), ("--batch-size", 16), ("--max-length", 512), ("--no-normalize", False), ("--use-fp16", False))
    add("parse-pdfs", parse, ("--manifest", "manifest.csv"), ("--raw-dir", "data/raw"), ("--output", "data/processed/pages.jsonl"), ("--limit", 0), ("--manifest-only", False), ("--extractor", ...), ("--tables", None), ("--show-errors", False))
    add("build-chunks", build_chunks, ("--input", "data/processed/pages.jsonl"), ("--output", "data/processed/chunks.jsonl"), ("--chunk-size", 512), ("--overlap", 100))
    add("build-index", build_index, ("--chunks", "data/processed/chunks.jsonl"), ("--index-path", "data/index"), ("--meta-path", None), ("--limit", 0), *model)
    add("search", search, ("--query", ...), ("--index-path", "data/index"), ("--top-k", 5), *model)
    add("chunking-experiment", experiment, ("--input", "data/processed/pages.jsonl"), ("--output-dir", None), ("--report", "chunking.md"), ("--config", []))
    add("inspect-chunks", inspect, ("--chunks", "data/processed/chunks.jsonl"), ("--keyword", None), ("--doc-id", None), ("--limit", 10))
    add("validate-dataset", validate, ("--manifest", "manifest.csv"), ("--raw-dir", "data/raw"), ("--show", 10))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    ship(spark)
    text = a.run(spark, a)
    print(text)
    return text


if __name__ == "__main__":
    main()
