"""inkstone: document catalogues, layout, tables, chunks and retrieval as Spark DataFrames."""

__version__ = "0.1.0"
