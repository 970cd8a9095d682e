"""Documents with shapes: JSON lines or Parquet in, and out again, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

FORMATS = ("json", "parquet")


def _checked(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format: {fmt}, not one of {FORMATS}")
    return fmt


def read_documents(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Documents of a folder. JSON without a schema reads shape objects as structs."""
    reader = spark.read.format(_checked(fmt))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream_documents(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str) -> DataFrame:
    """The same as a stream over the files that come into the folder."""
    return spark.readStream.format(_checked(fmt)).schema(schema).load(path)


def write_documents(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Enriched documents, members of the shape column nested."""
    df.write.format(_checked(fmt)).mode(mode).save(path)


def start_writing(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False) -> StreamingQuery:
    """A stream's rows to files, each row once; ``once`` ends it when the files at hand are done."""
    writer = df.writeStream.format(_checked(fmt)).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
