"""Canonical JSON of nested columns: keys sorted, ``", "`` and ``": "`` between parts, null for what is missing.

The text is what Python's ``json.dumps(value, ensure_ascii=False, sort_keys=True)`` gives, so digests agree
with those made outside Spark and don't depend on the order of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a case whose content counts.
CASE_FIELDS = [
    "api_name", "module", "scenario", "path", "preconditions", "steps", "expected_results", "validation_points", "db_checks", "tags", "priority", "source",
]
#: Control characters with an escape of their own.
SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _quoted(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(SHORT.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def json_text(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of ``value``: structs and maps of text, whole numbers, booleans and arrays of such."""
    if isinstance(kind, T.StringType):
        made = _quoted(value)
    elif isinstance(kind, T.IntegralType | T.BooleanType):
        made = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(": "), json_text(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        made = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pair = lambda e: F.concat(_quoted(e.key), F.lit(": "), json_text(e.value, kind.valueType))
        made = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.transform(F.map_keys(value), lambda k: k)), lambda k: pair(F.struct(k.alias("key"), F.element_at(value, k).alias("value")))), ", "), F.lit("}"))
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(made)


def content_hash(rows: DataFrame, fields: list[str] = CASE_FIELDS) -> Column:
    """SHA-256 of the canonical JSON of ``fields``; columns that ``rows`` lacks count as null."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    parts = [F.concat(_quoted(F.lit(f)), F.lit(": "), json_text(F.col(f"`{f}`"), kinds[f]) if f in kinds else F.lit("null")) for f in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)
