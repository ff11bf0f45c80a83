"""Chunking of a stream of pages: the batch operators, unchanged, as each page stands for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.operators import chunking
from inkstone.session import own_dir


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path)


def chunk_stream(pages: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """Chunks of the pages' texts, and of the tables they hold; late pages give late chunks, pages delivered again give their chunks again."""
    columns = ["chunk_id", "doc_id", "page", "chunk_type", "text"]
    one = chunking.section_chunks(pages, size, overlap).unionByName(chunking.fallback_chunks(pages, size, overlap)).select(*columns)
    if "tables" in pages.columns:
        one = one.unionByName(chunking.table_chunks(chunking.nested_tables(pages), size).select(*columns))
    return one


def run_once(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Work off what is there, exactly once, into a table, and read it."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def chunked_once(spark: SparkSession, path: str, name: str) -> DataFrame:
    at = f"{own_dir(spark)}/{name}"
    return run_once(chunk_stream(page_stream(spark, path)), f"{at}/out", f"{at}/state")
