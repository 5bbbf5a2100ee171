"""Small SQL text builders for nested JSON work.

Deep VARIANT expressions are written as SQL text: one string is parsed once in the JVM, while the
same tree built from Column objects takes thousands of calls from Python.
"""

from __future__ import annotations

from itertools import count

from tracelake.functions.text import WHITE_SPACE

_SPACES = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)
_names = count()


def fresh(prefix: str = "v") -> str:
    """A lambda variable no other expression uses."""
    return f"{prefix}{next(_names)}"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and use it several times in ``body(name)``."""
    name = fresh()
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def trim(x: str) -> str:
    return f"btrim({x}, '{_SPACES}')"


def filled(x: str) -> str:
    """Trimmed text, NULL if blank."""
    return f"nullif({trim(x)}, '')"


def first_filled(*xs: str) -> str:
    return f"coalesce({', '.join(filled(x) for x in xs)}, '')"


def member(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def kind(v: str) -> str:
    """OBJECT, ARRAY or the type of a single value. Only the top level is looked at, however deep the document is."""
    return (
        f"CASE WHEN try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL THEN 'OBJECT'"
        f" WHEN try_variant_get({v}, '$', 'array<variant>') IS NOT NULL THEN 'ARRAY' ELSE schema_of_variant({v}) END"
    )


def as_text(v: str) -> str:
    """The value if it is JSON text, else NULL."""
    return f"if(({kind(v)}) = 'STRING', try_variant_get({v}, '$', 'string'), NULL)"


def text(v: str, path: str) -> str:
    """Text member, '' if absent or of another type."""
    return f"coalesce({as_text(member(v, path))}, '')"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL)"


def is_array(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'array<variant>') IS NOT NULL)"


def as_object(v: str) -> str:
    return f"if({is_object(v)}, {v}, NULL)"


def items(v: str) -> str:
    """Elements of a JSON array; an empty list for anything else."""
    return f"coalesce(if({is_array(v)}, try_variant_get({v}, '$', 'array<variant>'), NULL), array())"


def number(v: str) -> str:
    """A JSON number cut to a whole number; NULL for other types."""
    whole = f"try_variant_get({v}, '$', 'bigint')"
    cut = f"bigint(try_variant_get({v}, '$', 'double'))"
    return f"CASE WHEN ({kind(v)}) = 'BIGINT' THEN {whole} WHEN ({kind(v)}) = 'DOUBLE' OR startswith({kind(v)}, 'DECIMAL') THEN {cut} END"


def number_at(v: str, path: str, default: str) -> str:
    return f"coalesce({number(member(v, path))}, {default})"


def contains_any(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
