"""The functions under their names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geoloom.functions import shape_udfs
from geoloom.kernel.shapes import TYPE_NAMES


_HEAD = "hex(substring(wkb, 1, 5))"
_CODE = f"IF(substring({_HEAD}, 1, 2) = '00', substring({_HEAD}, 7, 4), concat(substring({_HEAD}, 5, 2), substring({_HEAD}, 3, 2)))"
#: Functions that only read a header: SQL that the optimizer puts where they are called.
HEADERS = {
    "shape_type": f"""STRING RETURN CASE WHEN length(wkb) >= 5 AND cast(conv({_CODE}, 16, 10) AS int) % 1000 > 0
  THEN get(array({", ".join(f"'{TYPE_NAMES[k]}'" for k in sorted(TYPE_NAMES))}), cast(conv({_CODE}, 16, 10) AS int) % 1000 - 1) END""",
    "is_point_wkb": f"""BOOLEAN RETURN length(wkb) >= 5 AND substring({_HEAD}, 3, 8) = IF(substring({_HEAD}, 1, 2) = '00', '00000001', '01000000')""",
}


def register(spark: SparkSession) -> list[str]:
    """Registers every function for SQL text and returns the names.

    ``geo_simplify(wkb, zoom, algorithm, output_format)`` takes nulls for its last two defaults.
    """
    names = []
    for f in shape_udfs.SCALARS:
        spark.udf.register(f.sql_name, f.udf())
        names.append(f.sql_name)
    for name, body in HEADERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(wkb BINARY) RETURNS {body}")
        names.append(name)
    made = F.arrow_udf(shape_udfs._simplify_sql, shape_udfs.SIMPLIFIED_TYPE)
    spark.udf.register("geo_simplify", made)
    return [*names, "geo_simplify"]
