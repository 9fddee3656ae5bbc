"""Small helpers for writing DuckDB texts."""

from __future__ import annotations


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({columns})"


def any_match(column: str, patterns: list[str], options: str = "i") -> str:
    """One regexp test per pattern, joined with OR."""
    return "(" + " OR ".join(f"regexp_matches({column}, {lit(p)}, '{options}')" for p in patterns) + ")"


def any_contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


WS = "concat(' ', chr(9), chr(10), chr(13), chr(12), chr(11))"


def strip(column: str) -> str:
    return f"trim({column}, {WS})"
