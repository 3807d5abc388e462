"""Typed access to parsed JSON (VARIANT) columns, as SQL expression text.

A session file is open JSON: any field may hold any type.  These helpers give a value
only when it has the asked-for JSON type and NULL otherwise, so a plan never fails on a
malformed document.  They return SQL text for ``selectExpr`` / ``F.expr``; ``v`` is SQL
text as well (a column, a lambda variable or another expression).
"""

from __future__ import annotations

from stepwell.functions.text import SPACES

SPACE_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "'"
NO_VARIANT = "cast(NULL as variant)"


def parse(text: str) -> str:
    """Parsed document, or NULL when the text is not JSON."""
    return f"try_parse_json({text})"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def member(v: str, path: str) -> str:
    """Sub-value; NULL only when absent (a JSON null stays a value)."""
    return f"variant_get({v}, '{path}', 'variant')"


def loose(v: str, path: str = "$") -> str:
    """Scalar as text whatever its JSON type; for comparing with fixed words."""
    return f"try_variant_get({v}, '{path}', 'string')"


def _typed(v: str, path: str, kind: str, sql: str) -> str:
    inner = v if path == "$" else member(v, path)
    return f"if(schema_of_variant({inner}) = '{kind}', try_variant_get({v}, '{path}', '{sql}'), NULL)"


def string(v: str, path: str = "$") -> str:
    return _typed(v, path, "STRING", "string")


def text(v: str, path: str = "$") -> str:
    """A non-empty string."""
    return f"nullif({string(v, path)}, '')"


def boolean(v: str, path: str = "$") -> str:
    return _typed(v, path, "BOOLEAN", "boolean")


def integer(v: str, path: str = "$") -> str:
    return _typed(v, path, "BIGINT", "bigint")


def number(v: str, path: str) -> str:
    """Integer value of any numeric field."""
    return f"try_variant_get({v}, '{path}', 'bigint')"


def array(v: str, path: str = "$") -> str:
    return f"try_variant_get({v}, '{path}', 'array<variant>')"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL)"


def obj(v: str, path: str) -> str:
    """The sub-value itself when it is a JSON object."""
    return f"if({is_object(member(v, path))}, {member(v, path)}, NULL)"


def has_key(v: str, key: str) -> str:
    return f"({member(v, '$.' + key)} IS NOT NULL)"


def json(v: str, path: str = "$") -> str:
    """Canonical JSON text (object keys sorted); NULL when absent or JSON null."""
    return f"nullif(to_json({v if path == '$' else member(v, path)}), 'null')"


def present(v: str, path: str = "$") -> str:
    """True when the field is there and not JSON null."""
    return f"({json(v, path)} IS NOT NULL)"


def json_object(*pairs: tuple[str, str]) -> str:
    """JSON object of the non-null pairs; values are SQL giving JSON text.  NULL when empty."""
    parts = ", ".join(
        f"concat('\"{name}\":', {fragment})" for name, fragment in sorted(pairs, key=lambda p: p[0])
    )
    return f"nullif(concat('{{', concat_ws(',', {parts}), '}}'), '{{}}')"


def strip(s: str) -> str:
    return f"btrim({s}, {SPACE_LITERAL})"


def is_blank(s: str) -> str:
    return f"coalesce({strip(s)} = '', true)"


def texts(array_sql: str, lam: str, sep: str = "\\n") -> str:
    """Join the non-null results of ``lam`` (SQL lambda) over an array."""
    return f"array_join(filter(transform({array_sql}, {lam}), t -> t IS NOT NULL), '{sep}')"
