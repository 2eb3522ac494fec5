"""One rule for names: quoting, flattening, sanitising."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Namespaces that a flat name leaves out: fixed values.
DEFAULT_SCHEMAS = ("dbo", "public", "")


def quote(name: str, dialect: str) -> str:
    left, right = {"mssql": "[]", "mysql": "``", "spark": "``", "postgresql": '""'}[dialect]
    return f"{left}{name.lower().replace(right, right * 2)}{right}"


def flat_name(schema: str | None, table: str) -> str:
    schema = (schema or "").lower()
    return table.lower() if schema in DEFAULT_SCHEMAS else f"{schema}_{table.lower()}"


def table_name(schema: str | None, table: str, dialect: str) -> str:
    if dialect in ("mysql", "mongodb"):
        flat = flat_name(schema, table)
        return quote(flat, "mysql") if dialect == "mysql" else flat
    space = (schema or "").lower()
    if dialect == "postgresql":
        space = "public" if space in DEFAULT_SCHEMAS else space
    return f"{quote(space or 'dbo', dialect)}.{quote(table, dialect)}"


def parse_table(reference: str, default: str = "dbo") -> tuple[str, str]:
    parts = [p.strip().strip('[]`"') for p in reference.split(".")]
    return (parts[-2] or default, parts[-1]) if len(parts) > 1 else (default, parts[-1])


def sanitized(name: str) -> str:
    plain = re.sub(r"[^\w]", "_", name)
    return (f"f_{plain}" if plain[:1].isdigit() else plain).lower()


def unique_names(names: list[str]) -> list[str]:
    """Sanitised names; a later one that falls together with an earlier one gets a number."""
    out: list[str] = []
    for n in map(sanitized, names):
        k, free = 2, n
        while free in out:
            free, k = f"{n}_{k}", k + 1
        out.append(free)
    return out


def held_names(names: list[str], rule: Callable[[str], str]) -> dict[str, str]:
    """The name that each of `names` is held under: what the rule makes of it, in lower case. Of those that fall together one keeps it, before all one that has it already; the others get numbers."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for n in sorted(names, key=lambda n: (rule(n).lower() != n, n)):
        k, free = 2, rule(n).lower()
        while free in taken:
            free, k = f"{rule(n).lower()}_{k}", k + 1
        taken.add(free)
        out[n] = free
    return out
