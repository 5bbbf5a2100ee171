"""Typed reads from the metadata JSON document.

``try_parse_json`` yields NULL for bad text, so a broken document reads as an empty one.
The type of a value is checked before it is read: a number is not a string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import squeeze


def parse(raw: Column) -> Column:
    return F.try_parse_json(raw)


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY or the type of a single value; only the top level is looked at."""
    return (
        F.when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), F.lit("OBJECT"))
        .when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), F.lit("ARRAY"))
        .otherwise(F.schema_of_variant(value))
    )


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _member(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "variant")


def meta_string(raw: Column, key: str) -> Column:
    """Trimmed text; '' when absent or when the value is not JSON text."""
    return doc_string(parse(raw), key)


def doc_string(doc: Column, key: str) -> Column:
    value = _member(doc, key)
    return F.coalesce(
        F.when(_kind(value) == "STRING", squeeze(_text(value))), F.lit("")
    )


def meta_long(raw: Column, key: str) -> Column:
    return doc_long(parse(raw), key)


def doc_long(doc: Column, key: str) -> Column:
    """Whole number: JSON numbers truncate, text must be an integer; otherwise NULL."""
    value = _member(doc, key)
    text = squeeze(_text(value))
    from_text = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    from_number = F.try_variant_get(value, "$", "double").cast("decimal(38,6)").cast("bigint")
    exact = F.try_variant_get(value, "$", "bigint")
    kind = _kind(value)
    return (
        F.when(kind == "STRING", from_text)
        .when(kind == "BIGINT", exact)
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), from_number)
    )


def meta_bool(raw: Column, key: str) -> Column:
    return doc_bool(parse(raw), key)


def doc_bool(doc: Column, key: str) -> Column:
    """JSON booleans and the words true/false; otherwise NULL."""
    value = _member(doc, key)
    word = F.lower(squeeze(_text(value)))
    kind = _kind(value)
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(
        kind == "STRING", F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))
    )


def json_or_raw(raw: Column) -> Column:
    """The JSON value of the text, or the text itself as a JSON string; blank gives NULL."""
    filled = F.nullif(squeeze(raw), F.lit(""))
    return F.when(filled.isNotNull(), F.coalesce(parse(raw), raw.cast("variant")))


def metadata_view(raw: Column) -> Column:
    """The metadata object; text that is no JSON object is shown under the key ``raw``."""
    doc = parse(raw)
    is_object = F.try_variant_get(doc, "$", "map<string,variant>").isNotNull()
    filled = F.nullif(squeeze(raw), F.lit(""))
    return F.when(
        filled.isNotNull(),
        F.when(is_object, doc).otherwise(F.parse_json(F.to_json(F.struct(raw.alias("raw"))))),
    )
