"""Identifiers: mapping from source to target, quoting, and stable ids."""

from __future__ import annotations

import hashlib

LONGEST = 63  # bytes of a target identifier


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def stable_name(name: str, identity: str) -> str:
    """name, or if it is too long its first 54 bytes at most, cut between characters, an underscore and 8 hex digits of the identity."""
    data = name.encode()
    if len(data) <= LONGEST:
        return name
    return f"{data[:54].decode('utf-8', 'ignore')}_{digest(identity)[:8]}"


def _snake(name: str) -> str:
    """Lower case, with an underscore where a capital follows a small letter or digit, or leads into small letters."""
    out = ""
    for before, c, after in zip(" " + name, name, name[1:] + " ", strict=False):
        if out and c.isupper() and (before.islower() or before.isnumeric() or after.islower()):
            out += "_"
        out += c.lower()
    return out


def mapped_name(name: str, policy: str, identity: str) -> str:
    """policy: preserve, downcase or snake_case."""
    made = {"preserve": lambda s: s, "downcase": str.lower, "snake_case": _snake}[policy](name)
    return stable_name(made, identity)


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def qualified(schema: str, name: str) -> str:
    return f"{quote(schema)}.{quote(name)}"


def spark_quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """The inside of an escape string, quotes included; E goes before it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def table_id(database: str, table: str) -> str:
    return f"t_{digest(f'{database}.{table}')[:16]}"
