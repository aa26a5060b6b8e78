"""Cast rules ``left=target``: left is ``table.column`` or the head of a type text."""

from __future__ import annotations

import re
from dataclasses import dataclass

TARGET = re.compile(r"[A-Za-z][A-Za-z0-9_ ]*(\(\s*\d+\s*(,\s*\d+\s*)?\))?(\[\])?")


@dataclass(frozen=True)
class CastRules:
    by_column: dict[tuple[str, str], str]
    by_type: tuple[tuple[str, str], ...]

    def lookup(self, table: str, column: str, type_text: str) -> str | None:
        """A column's own rule first; else the first type rule whose left side starts the type."""
        if hit := self.by_column.get((table.lower(), column.lower())):
            return hit
        low = type_text.strip().lower()
        return next((target for head, target in self.by_type if low.startswith(head)), None)


def parse_rules(rules: list[str]) -> CastRules:
    """Raises ValueError on a rule with an empty side, a target outside the grammar or two dots."""
    columns: dict[tuple[str, str], str] = {}
    types: list[tuple[str, str]] = []
    for rule in rules:
        left, sep, target = (x.strip() for x in rule.partition("="))
        if not sep or not left or not TARGET.fullmatch(target):
            raise ValueError(f"bad cast rule {rule!r}: write table.column=type or type=type")
        low = left.lower()
        if "(" in low or "." not in low:
            types.append((low, target))
            continue
        table, _, column = low.partition(".")
        if not table or not column or "." in column:
            raise ValueError(f"bad cast rule {rule!r}: the left side is table.column")
        columns[table, column] = target
    return CastRules(columns, tuple(types))
