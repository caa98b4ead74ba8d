"""JSON that is taken at its word: one value, no repeated key, and types that differ are different.

Texts are parsed to VARIANT, which refuses repeated keys and keeps ``1``,
``"1"`` and ``false`` apart, and fields are read with the type that they must
have. ``get_json_object`` would do neither.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.bound import bound

#: What ``schema_of_variant`` calls the kinds that are asked for.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}


def parsed(text: Column) -> Column:
    """The value of a JSON text, null for any that isn't strict JSON.

    Spark's parser leaves what follows the first value unread, so the text is
    also parsed as the only member of an object and of an array: nothing but one
    whole value fits into both.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(alone.isNotNull(), F.try_variant_get(whole, "$.v", "variant"))


def canonical(value: Column) -> Column:
    """A value's text with sorted keys: equal values, and only those, have equal texts (1.0 is 1)."""
    return F.to_json(value)


def fields(value: Column) -> Column:
    """map<string, variant> of an object, null for any other value."""
    return value.try_cast("map<string,variant>")


def field(value: Column, name: str) -> Column:
    """A field's value, null where the object lacks it."""
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def record(value: Column, names: Iterable[str]) -> Column:
    """Fields of an object by name, as a struct of values; null for any other value, a missing field is null."""
    return value.try_cast("struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def is_kind(value: Column, kind: str) -> Column:
    """Whether a value is of a kind: string, integer, boolean, null, array or object."""
    if kind in ("array", "object"):
        return value.try_cast({"array": "array<variant>", "object": "map<string,variant>"}[kind]).isNotNull()
    return F.coalesce(value.isNotNull() & (F.schema_of_variant(value) == KINDS[kind]), F.lit(False))


def typed(value: Column, name: str, kind: str) -> Column:
    """A field of a string, integer or boolean; null where it is missing or of another kind."""
    return bound(field(value, name), lambda found: exactly(found, kind))


def exactly(value: Column, kind: str) -> Column:
    """A string, integer or boolean; null for a value of another kind."""
    to = {"string": "string", "integer": "long", "boolean": "boolean"}[kind]
    return F.when(is_kind(value, kind), F.try_variant_get(value, "$", to))


def with_field(value: Column, name: str, text: Column) -> Column:
    """The JSON text of an object with one field set to a string and every other as it was, keys sorted."""
    new = F.parse_json(F.to_json(F.struct(text.alias("x"))))
    moved = F.transform_values(fields(value), lambda k, v: F.when(k == name, F.try_variant_get(new, "$.x", "variant")).otherwise(v))
    return F.to_json(moved)
