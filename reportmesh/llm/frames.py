"""Spark side of the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: bounds what one task holds at a time.
BATCH_ROWS = "2000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads: extra columns, whatever their names, are left out."""
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def map_arrow(df: DataFrame, one: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``one`` turns a batch into batches; state stays within a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from one(batch)

    return df.mapInArrow(every, schema)


def travelling(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more... and ``body``, the compressed text: for joins that must shuffle whole texts."""
    own = documents(docs, *more)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        body = [None if t is None else squeeze(t.as_buffer()) for t in _values(batch.column("text"))]
        columns = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(body, pa.binary())], [*columns, "body"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("text").schema)
    return map_arrow(own, one, f"{kinds}, body binary")


def _values(column: pa.Array) -> list:
    return [v if v.is_valid else None for v in column]


def arrived(column: pa.Array) -> pa.Array:
    """Texts of a column of compressed ones, as bytes."""
    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([None if v is None else open_(v.as_buffer()) for v in _values(column)], pa.large_binary())


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """One fifth of the documents, by the checksum of their id; never used for learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % 5 == 0


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine (each worker has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)
