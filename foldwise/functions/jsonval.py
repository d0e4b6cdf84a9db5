"""Typed access to JSON held as VARIANT.

A field is judged by the VARIANT's own type and, for truth tests, by its JSON text, in which a string
keeps its quotes.  That separates ``7`` from ``"7"`` and null from a missing key without a Python UDF.
All functions take and return Spark SQL expression text.
"""

from __future__ import annotations

from foldwise.functions.text import let, raw

FALSY = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][+-]?[0-9]+)?)$'
NO_ITEMS = "cast(array() as array<variant>)"


def field(value: str, path: str) -> str:
    """Member of a VARIANT as VARIANT; null when the path is missing or the value is no container."""
    return f"try_variant_get({value}, '$.{path}', 'variant')"


def _of_type(value: str, kind: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), '{kind}'), false)"


def is_string(value: str) -> str:
    return _of_type(value, "STRING")


def is_object(value: str) -> str:
    return _of_type(value, "OBJECT<")


def is_array(value: str) -> str:
    return _of_type(value, "ARRAY<")


def is_true(value: str) -> str:
    return f"coalesce(to_json({value}) = 'true', false)"


def truthy(value: str) -> str:
    """False for missing, null, false, zero and empty values."""
    return let(f"to_json({value})", "js", f"js is not null and not js rlike {raw(FALSY)}")


def string_or_null(value: str) -> str:
    """Content of a JSON string; null for every other type."""
    return let(value, "sv", f"case when {is_string('sv')} then try_variant_get(sv, '$', 'string') end")


def as_text(value: str) -> str:
    """Text form of any value: strings as they are, booleans capitalised, the rest as JSON."""
    return let(
        value,
        "av",
        f"case when {is_string('av')} then try_variant_get(av, '$', 'string') "
        "when to_json(av) in ('true', 'false') then initcap(to_json(av)) "
        "when to_json(av) = 'null' then 'None' else to_json(av) end",
    )


def first_truthy(*values: str) -> str:
    """First truthy VARIANT of the list, else null."""
    return f"get(filter(array({', '.join(values)}), tv -> {truthy('tv')}), 0)"


def array_items(value: str) -> str:
    """Elements of a JSON array as array<variant>; an empty array for other types."""
    items = let(value, "iv", f"case when {is_array('iv')} then try_variant_get(iv, '$', 'array<variant>') end")
    return f"coalesce({items}, {NO_ITEMS})"
