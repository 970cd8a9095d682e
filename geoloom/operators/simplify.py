"""Per-row simplification for a map zoom."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.options import Algorithm, OutputFormat, ScriptParams, algorithm, output_format, zoom_level
from geoloom.functions.shape_udfs import SIMPLIFIED_TYPE, _simplified
from geoloom.kernel.measures import tolerance

SCRIPT = "geo_simplify"


def geo_simplify(
    wkb: Column,
    zoom: int,
    how: str | Algorithm = Algorithm.DOUGLAS_PEUCKER,
    fmt: str | OutputFormat = OutputFormat.GEOJSON,
) -> Column:
    """(shape, type, real_type) of a WKB column, simplified by the degrees of a pixel at ``zoom``.

    A shape that vanishes is the point at its first vertex, of the type SimplificationPoint and
    without real_type. A null gives a null, bytes that are no shape are an error.
    """
    degrees, name, fmt = tolerance(zoom_level(zoom)), algorithm(how).value, output_format(fmt)

    def over(values: pa.Array) -> pa.Array:
        return _simplified(values, degrees, name, fmt)

    return F.arrow_udf(over, SIMPLIFIED_TYPE)(wkb)


def compile_script(name: str, params: dict) -> Callable[[DataFrame], Column]:
    """The script of a name, bound to its parameters; of an array column the first value counts.

    A column that is missing, or has no value in a row, gives nulls.
    """
    if name != SCRIPT:
        raise ValueError(f"unknown script: {name}")
    bound = ScriptParams.parse(params)

    def over(df: DataFrame) -> Column:
        parts = bound.field.split(".")
        if parts[0] not in df.columns:
            return F.lit(None).cast(SIMPLIFIED_TYPE)
        kind = df.select(F.col(bound.field).alias("c")).schema["c"].dataType.typeName()
        wkb = F.try_element_at(F.col(bound.field), F.lit(1)) if kind == "array" else F.col(bound.field)
        return geo_simplify(wkb, bound.zoom, bound.algorithm, bound.output_format)

    return over
