"""Quality statistics of texts, and what kind of text they are: prose, list, table or junk.

Each line of a text is labelled by a hidden Markov model over line statistics (``line_features``,
``line_hmm``); the labels' shares of the characters are then summed for each text. The model is
fitted on a bounded sample of labelled texts; everything else is computed for every text, whole.

Defined results
    null, empty and blank texts   0 characters in lines, null ratios and shares, no label
    repeated ids                  a row each
    very long texts               all of their lines; a line of over 200 signs is labelled in pieces
    ties                          a share of exactly one half of other lines still counts as prose
    no labelled text              every line counts as prose
    other columns                 ignored; an empty table gives no rows
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.line_features import MARK, STOP, SYMBOL, Lines, common_hashes
from geoloom.llm.line_hmm import LABELS, LineModel, fit
from geoloom.llm.tokens import slices

CHUNK_BYTES = 2 << 20


@dataclass(frozen=True)
class QualityModel:
    """A line model, None where nothing was labelled, and the hashes of common words."""

    lines: LineModel | None
    common: np.ndarray


def fit_quality(
    documents: DataFrame, labels: DataFrame, common_words: DataFrame, id_column: str = "doc_id", text: str = "text",
    most_labelled: int = 2000, most_bytes: int = 32 << 20, longest_mixed: int = 20_000, most_common: int = 10_000,
) -> QualityModel:
    """A model from labelled texts.

    The sample comes to the driver and is bounded: the ``most_labelled`` labelled ids that are first by
    hash, and of their texts, in that order, as many as have ``most_bytes`` bytes together; texts of
    more than an eighth of that are left out. Only texts of under ``longest_mixed`` characters are also put together in mixtures. The ``most_common`` first
    words of ``common_words`` come to the driver too.
    """
    words = common_words.where("word IS NOT NULL").orderBy("word_rank", "word").limit(most_common).select("word").collect()
    sample = labels.where(F.col("label").isin(*LABELS) & F.col(id_column).isNotNull())
    sample = sample.orderBy(F.xxhash64(id_column), "label").limit(most_labelled).select(F.col(id_column).alias("_id"), "label")
    texts = documents.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    texts = texts.where((F.trim("_text") != "") & (F.octet_length("_text") <= most_bytes // 8)).join(F.broadcast(sample), "_id")
    first = Window.orderBy(F.xxhash64("_id"), "_id", "label", "_text")  # over the texts of ``most_labelled`` ids
    texts = texts.withColumn("_upto", F.sum(F.octet_length("_text")).over(first)).where(F.col("_upto") <= most_bytes)
    rows = texts.select("_id", "_text", "label").collect()
    rows.sort(key=lambda r: (r["_id"], r["label"], r["_text"]))
    common = common_hashes([r["word"] for r in words])
    if not rows:
        return QualityModel(None, common)
    numbers = np.array([LABELS.index(r["label"]) for r in rows])
    return QualityModel(fit([r["_text"] for r in rows], numbers, common, longest_mixed), common)


def save_model(spark: SparkSession, model: QualityModel, path: str) -> None:
    """Writes a model as a table of one row, so that texts to come need no new fit."""
    arrays = {"common": model.common}
    if model.lines:
        arrays |= {n: getattr(model.lines, n) for n in _ARRAYS} | {f"weights_{i}": w for i, w in enumerate(model.lines.weights)}
    raw = io.BytesIO()
    np.savez_compressed(raw, **arrays)
    spark.createDataFrame([(bytearray(raw.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> QualityModel:
    with np.load(io.BytesIO(spark.read.parquet(path).first()["model"]), allow_pickle=False) as held:
        if "shift" not in held:
            return QualityModel(None, held["common"])
        weights = [held[f"weights_{i}"] for i in range(2)]
        return QualityModel(LineModel(weights, *(held[n] for n in _ARRAYS)), held["common"])


_ARRAYS = ("shift", "scale", "log_share", "log_start", "log_step")


_STATS = [
    ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("n_words", pa.int64()), ("mean_word_length", pa.float64()),
    ("symbol_ratio", pa.float64()), ("stop_line_share", pa.float64()), ("common_share", pa.float64()),
    *((f"{name}_share", pa.float64()) for name in LABELS), ("label", pa.string()),
]


def _measured(texts: pa.Array, model: QualityModel) -> list[pa.Array]:
    lines = Lines(texts, model.common)
    n = len(texts)
    sums = lambda weights: np.bincount(lines.text, weights, n)
    chars, pieces, words = sums(lines.chars), np.bincount(lines.text, minlength=n), sums(lines.words)
    none = pieces == 0

    def ratio(top: np.ndarray, bottom: np.ndarray) -> pa.Array:
        return pa.array(top / np.maximum(bottom, 1), mask=none | (bottom == 0))

    path = model.lines.label(lines.features, lines.text) if model.lines else np.zeros(len(lines.text), np.int64)
    held = np.bincount(lines.text * len(LABELS) + path, lines.chars, n * len(LABELS)).reshape(n, -1)
    other = held[:, 1:].sum(axis=1) * 2 > chars
    label = np.where(other, 1 + held[:, 1:].argmax(axis=1), 0)
    return [
        pa.array(lines.text_chars),
        pa.array(sums(~lines.inner_piece).astype(np.int64)),
        pa.array(words.astype(np.int64)),
        ratio(sums(lines.word_chars), words),
        ratio(sums(lines.count[:, SYMBOL] + lines.count[:, MARK] + lines.count[:, STOP]), chars),
        ratio(sums(lines.ends_stop), sums(~lines.inner_piece)),
        ratio(sums(lines.common), words),
        *(ratio(held[:, i], chars) for i in range(len(LABELS))),
        pa.array(np.array(LABELS)[label], pa.string(), mask=none),
    ]


def _stats(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n in slices(batch.column(1), CHUNK_BYTES):
            texts = batch.column(1).slice(at, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), *_measured(texts, model)], [batch.schema.names[0], *(name for name, _ in _STATS)]
            )


def text_quality(df: DataFrame, id_column: str, text: str, model: QualityModel) -> DataFrame:
    """The statistics of each text; ``label`` is prose unless other lines hold over half of the characters."""
    kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType()}
    id_field = df.select(id_column).schema.fields[0]
    schema = T.StructType([id_field, *(T.StructField(n, kinds[k]) for n, k in _STATS)])
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(id_column, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(lambda it: _stats(it, sent.value), schema)
