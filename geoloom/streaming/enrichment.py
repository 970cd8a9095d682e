"""Enrichment of a stream of documents: stateless, append only, no watermark."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from geoloom.operators.enrich import enrich
from geoloom.sources.documents import start_writing, stream_documents


def enrich_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType | str, field: str,
    fmt: str = "parquet", once: bool = False, **options,
) -> StreamingQuery:
    """Reads documents as they come, enriches the columns that match ``field`` and writes them.

    ``options`` are those of ``enrich``. The checkpoint folder must be on storage that all share.
    """
    documents = stream_documents(spark, source, fmt, schema)
    return start_writing(enrich(documents, field, **options), target, checkpoint, fmt, once)
