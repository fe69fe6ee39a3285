"""Company fundamentals from a key/value JSON document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The document keys the reference reads (types are our choice).
FUNDAMENTALS_SCHEMA = T.StructType([
    T.StructField("profitMargins", T.DoubleType()),
    T.StructField("netIncomeToCommon", T.LongType()),
    T.StructField("enterpriseToEbitda", T.DoubleType()),
    T.StructField("totalCash", T.LongType()),
    T.StructField("totalDebt", T.LongType()),
    T.StructField("ebitdaMargins", T.DoubleType()),
    T.StructField("operatingMargins", T.DoubleType()),
    T.StructField("debtToEquity", T.DoubleType()),
    T.StructField("longBusinessSummary", T.StringType()),
])


def load_fundamentals(df: DataFrame, json_col: str, keys: Sequence[str] = ("symbol",),
                      schema: T.StructType = FUNDAMENTALS_SCHEMA) -> DataFrame:
    """Project a JSON column to typed columns; a missing key is NULL in that column only.

    Narrow row-wise parsing (``from_json``): no shuffle, scales with the input.
    """
    parsed = df.select(*keys, F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"}).alias("_doc"))
    return parsed.select(*keys, *[F.col("_doc")[f.name].alias(f.name) for f in schema.fields])


def load_any_document(df: DataFrame, json_col: str, keys: Sequence[str] = ("symbol",), paths: dict[str, Sequence[str]] | None = None,
                      schema: T.StructType = FUNDAMENTALS_SCHEMA) -> DataFrame:
    """Typed columns of documents whose shape is not known beforehand, through the VARIANT type.

    ``paths`` gives a column the places where a document may hold it (``$.a.b``,
    ``$.list[0].c``), the first one with a value of the column's type wins; a column
    without paths is looked up at the top. A missing place, a value that isn't of the
    type, and text that isn't JSON are NULL. The text is parsed once per row.
    """
    places = {f.name: list((paths or {}).get(f.name) or [f"$.{f.name}"]) for f in schema.fields}
    doc = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("_doc"))
    return doc.select(*keys, *[F.coalesce(*[_typed("_doc", path, f.dataType) for path in places[f.name]]).alias(f.name) for f in schema.fields])


def _typed(doc: str, path: str, kind: T.DataType) -> Column:
    """The value at ``path`` where it is of the type: a number for a number, a string for a string (no casts between them)."""
    found = F.try_variant_get(F.col(doc), path, "variant")
    is_string = F.startswith(F.schema_of_variant(found), F.lit("STRING"))
    is_bool = F.schema_of_variant(found) == "BOOLEAN"
    fits = is_string if isinstance(kind, T.StringType) else ~is_string & ~is_bool
    return F.when(fits, F.try_variant_get(F.col(doc), path, kind.simpleString()))
