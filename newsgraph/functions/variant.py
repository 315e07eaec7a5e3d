"""Column helpers that read VARIANT values the way pydantic's lax mode validates them.

All helpers are built-in Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen.  ``path`` is a JSONPath such as ``'$.name'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def parse_single(text: Column) -> Column:
    """Parse a whole JSON document; NULL when invalid or followed by junk.

    Wrapping in ``[...]`` and requiring exactly one element rejects trailing text
    (which ``try_parse_json`` alone would accept) and ``a,b`` style content.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 1
    return F.when(one, F.try_variant_get(wrapped, "$[0]", "variant"))


def get(v: Column, path: str) -> Column:
    """Sub-value as VARIANT: SQL NULL when the key is missing, variant null when JSON null."""
    return F.try_variant_get(v, path, "variant")


def fields(v: Column, names) -> Column:
    """All named fields of a JSON object in one read: STRUCT of VARIANTs.

    The struct is NULL when ``v`` is not an object; a missing key gives a SQL NULL
    field, a JSON null gives a variant null (the distinction pydantic makes).
    """
    ddl = ",".join(f"`{n}`:variant" for n in names)
    return F.try_variant_get(v, "$", f"struct<{ddl}>")


def kind(v: Column) -> Column:
    """JSON kind of a scalar: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID.

    Containers give their full schema text (``OBJECT<...>``/``ARRAY<...>``); use
    ``is_object`` / ``as_array`` for those.
    """
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """True for a JSON object (a cast to a one-field struct only succeeds on objects)."""
    return F.coalesce(F.try_variant_get(v, "$", "struct<_probe:int>").isNotNull(), F.lit(False))


def as_array(v: Column) -> Column:
    """ARRAY<VARIANT> when ``v`` is a JSON array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_str(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def str_or_null_ok(v: Column) -> Column:
    """Optional[str]: missing, JSON null or a string."""
    return v.isNull() | F.coalesce(kind(v).isin("STRING", "VOID"), F.lit(False))


def string(v: Column) -> Column:
    """String value only when the JSON value is a string (no int -> str coercion)."""
    return F.when(is_str(v), F.try_variant_get(v, "$", "string"))


def lax_double(v: Column) -> Column:
    """float field: numbers, booleans and numeric strings; NULL otherwise.

    The variant -> double cast already returns NULL for objects, arrays, null and
    non-numeric text, which is exactly the lax float rule.
    """
    return F.try_variant_get(v, "$", "double")


def lax_int(v: Column) -> Column:
    """int field: integral numbers or numeric strings (7.5 is an error, not 7)."""
    d = lax_double(v)
    return F.when((d == F.floor(d)) & ~F.isnan(d) & (F.abs(d) < 9.0e18), d.cast("bigint"))


def in_range(x: Column, lo: float, hi: float) -> Column:
    """Closed range check; NaN and NULL fail (Spark orders NaN above every number)."""
    return F.coalesce((x >= lo) & (x <= hi) & ~F.isnan(x), F.lit(False))


def string_list(v: Column) -> Column:
    """List[str]: a JSON array whose elements are all strings, else NULL."""
    arr = as_array(v)
    all_str = F.forall(arr, lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False)))
    return F.when(all_str, F.transform(arr, lambda e: F.try_variant_get(e, "$", "string")))


def string_map(v: Column) -> Column:
    """Dict[str, Any] rendered as MAP<STRING,STRING>: scalars as text, nested as JSON."""
    return F.try_variant_get(v, "$", "map<string,string>")
