"""Records that differ only in how they are written.

Three steps. Rows equal byte for byte are collapsed first, with their counts; only the distinct
spellings are brought to a canonical text; spellings are then grouped on the whole canonical text,
and their counts are summed. Members of spellings of several rows find their record again over digests,
with hot keys split.

Canonical form of a field
    digits    letters and digits, lower case, with a minus sign right before the first digit and
              points between digits; other signs between digits (thousands) are left out
    hex       letters and digits, lower case
    shape     words in lower case and numbers with sign, digits, decimal point and exponent, in
              order, one blank between them
    json      fields in order of their canonical names; of strings and names the letters and
              digits, case folded; numbers as they are written; lists in their order

Defined results
    null              equals only null; an empty or blank field is an empty text, not a null
    text that is no JSON   read as under ``shape``
    numbers           1.50 and 1.5 differ, and so do 1 and 1.0; +1 and 1 are the same
    ties              the record is named after its smallest id
    repeated ids      each row is a copy of its own; a null id is kept as a member
    empty table       an empty result
    other columns     ignored
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.operators.balance import join_balanced
from geoloom.plans.lineage import cut

_NUMBER = r"-?(?:\d+\.\d+|\d+|\.\d+)(?:e[+-]?\d+)?"
_WORD_OR_NUMBER = re.compile(rf"{_NUMBER}|[^\W\d_]+")


def digits_text(c: Column) -> Column:
    """Canonical text of a field that holds one number."""
    body = F.regexp_replace(F.lower(c), r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.]", "")
    return F.concat(F.when(c.rlike(r"^[^\p{L}\p{N}]*-\.?[0-9]"), F.lit("-")).otherwise(F.lit("")), body)


def hex_text(c: Column) -> Column:
    """Canonical text of bytes written in hexadecimal digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def shape_text(c: Column) -> Column:
    """Canonical text of a shape: words and numbers in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"-?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)(?:e[+-]?[0-9]+)?|\p{L}+"), F.lit(0))
    return F.array_join(found, " ")


class _Number(str):
    """A number as it is written."""


class _Fields(list):
    """The (name, value) pairs of a JSON object, names repeated or not."""


def _bare(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def _json_text(value) -> str:
    if isinstance(value, _Number):
        return value.lower()
    if isinstance(value, str):
        return _bare(value)
    if isinstance(value, _Fields):
        return "{" + ",".join(sorted(f"{_bare(k)}:{_json_text(v)}" for k, v in value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json_text, value)) + "]"
    return {True: "true", False: "false", None: "null"}[value]


def json_text(text: str | None) -> str | None:
    """Canonical text of a JSON value."""
    if text is None:
        return None
    try:
        value = json.loads(text, object_pairs_hook=_Fields, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
        return _json_text(value)
    except (json.JSONDecodeError, RecursionError):
        return " ".join(_WORD_OR_NUMBER.findall(text.casefold()))


def _with_json(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in at:
            held = columns[i].dictionary_encode()  # texts that recur with other fields are read once
            columns[i] = pa.array(map(json_text, held.dictionary.to_pylist()), pa.string()).take(held.indices)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


FORMS = {"digits": digits_text, "hex": hex_text, "shape": shape_text}


#: Byte-identical rows up to so many distinct ones are found by sending these to every task.
MOST_SENT = 100_000


def collapse_spellings(
    df: DataFrame, id_column: str, forms: dict[str, str], only_repeated: bool = False, with_members: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """The records of ``df`` and their members.

    ``forms`` maps string columns to digits, hex, shape or json. Records are (keep_id, copies, and
    the canonical text of each field under its name); members are (id, keep_id), a row for each row
    of ``df``, or, with ``only_repeated``, for each row of a record of several copies; None without
    ``with_members``.
    """
    if unknown := set(forms.values()) - {*FORMS, "json"}:
        raise ValueError(f"forms: {sorted(unknown)}")
    fields = [f"_f{i}" for i in range(len(forms))]
    rows = df.select(F.col(id_column).alias("_id"), *(F.col(c).cast("string").alias(f) for c, f in zip(forms, fields)))
    digest = F.unhex(F.md5(F.to_json(F.struct(*fields))))  # to_json leaves nulls out

    raw = rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    texts = raw.select(
        digest.alias("_raw"),
        "_n",
        "_first",
        *((FORMS[form](F.col(f)) if form in FORMS else F.col(f)).alias(f) for f, form in zip(fields, forms.values())),
    )
    at = [3 + i for i, form in enumerate(forms.values()) if form == "json"]
    if at:
        texts = texts.mapInArrow(lambda it: _with_json(it, at), texts.schema)
    texts = cut(texts.select("*", digest.alias("_record")))

    records = texts.groupBy(*fields).agg(F.min("_first").alias("keep_id"), F.sum("_n").alias("copies"))
    shown = records.select("keep_id", "copies", *(F.col(f).alias(c) for c, f in zip(forms, fields)))
    if not with_members:
        return shown, None
    named = records.select(digest.alias("_record"), "keep_id", "copies")
    if only_repeated:
        named = named.where("copies > 1")
    owners = join_balanced(texts.select("_raw", "_n", "_first", "_record"), named.select("_record", "keep_id"), "_record", ["_raw"])
    owners = cut(owners.select("_raw", "_n", "_first", "keep_id"))
    # a spelling of one row has that row's id; of others, the rows are looked for
    members = owners.where("_n = 1").select(F.col("_first").alias("id"), "keep_id")
    several = owners.where("_n > 1").select("_raw", "keep_id")
    if not several.isEmpty():
        found = join_balanced(rows.select("_id", digest.alias("_raw")), several, "_raw", ["_id"], most_sent=MOST_SENT)
        members = members.union(found.select("_id", "keep_id"))
    return shown, members
