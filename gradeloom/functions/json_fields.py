"""Type-strict readers for stored JSON documents.

Documents are parsed once into VARIANT; a field is taken only when its JSON type
is the wanted one, so ``"5"`` is never a number and ``true`` never 1.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ALLOW_DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def accept_duplicate_keys(spark: SparkSession) -> None:
    """Let the last of several equal keys win, as the stored records assume."""
    spark.conf.set(ALLOW_DUPLICATE_KEYS, "true")


def once(value: Column) -> Column:
    """A value that is computed once per row, as a column of its own in a select.

    Spark repeats an expression in each later step that names it and moves filters on it
    into joins below; behind a generator it does neither.
    """
    return F.explode(F.array(value))


def parse_document(text: Column) -> Column:
    """The document as VARIANT, NULL when it is not JSON.

    Bare ``NaN`` and ``Infinity`` are read as null: neither is a usable number
    in any field, so both readings fail the same checks.
    """
    finite = F.regexp_replace(text, r"([:\[,]\s*)(?:NaN|-?Infinity)(?=\s*[,}\]])", "$1null")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(finite))


def json_type(document: Column, path: str) -> Column:
    """Upper-case type name at the path, NULL when nothing is there."""
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def has_field(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "variant").isNotNull()


def is_object(document: Column, path: str = "$") -> Column:
    return F.coalesce(json_type(document, path).startswith("OBJECT"), F.lit(False))


def is_array(document: Column, path: str = "$") -> Column:
    return F.coalesce(json_type(document, path).startswith("ARRAY"), F.lit(False))


def _is_number_type(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def is_number(document: Column, path: str) -> Column:
    return F.coalesce(_is_number_type(json_type(document, path)), F.lit(False))


def text_field(document: Column, path: str) -> Column:
    return F.when(json_type(document, path) == "STRING", F.try_variant_get(document, path, "string"))


def number_field(document: Column, path: str) -> Column:
    return F.when(
        _is_number_type(json_type(document, path)), F.try_variant_get(document, path, "double")
    )


def int_field(document: Column, path: str) -> Column:
    """A JSON integer; one beyond 64 bits is NULL."""
    return F.when(json_type(document, path) == "BIGINT", F.try_variant_get(document, path, "long"))


def bool_field(document: Column, path: str) -> Column:
    return F.when(
        json_type(document, path) == "BOOLEAN", F.try_variant_get(document, path, "boolean")
    )


def members(document: Column, path: str, names: list[str]) -> Column:
    """The named members of an object as one struct of VARIANT values.

    One extraction instead of one per member; NULL when the path holds no object.
    """
    kind = ", ".join(f"{name}: variant" for name in names)
    return F.try_variant_get(document, path, f"struct<{kind}>")


def elements(document: Column, path: str = "$") -> Column:
    """The elements of an array as VARIANT values, NULL when it is no array."""
    return F.try_variant_get(document, path, "array<variant>")


def as_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_number(value: Column) -> Column:
    return F.when(
        _is_number_type(F.schema_of_variant(value)), F.try_variant_get(value, "$", "double")
    )


def as_int(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "long"))


def as_bool(value: Column) -> Column:
    return F.when(
        F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    )


def value_is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
