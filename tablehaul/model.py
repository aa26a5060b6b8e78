"""Metadata that lives on the driver; table rows never do."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    extra: str = ""
    generation: str = ""
    comment: str = ""
    is_uuid: bool = False
    demotion: str = ""
    cast: str | None = None


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[tuple[str, int | None, bool], ...]  # name, prefix length, descending
    unique: bool = False
    method: str = "BTREE"


@dataclass(frozen=True)
class ForeignKey:
    name: str
    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...] = ()
    key: tuple[str, ...] = ()
    engine: str = "InnoDB"
    comment: str = ""
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    triggers: tuple[str, ...] = ()

    @property
    def resumable(self) -> bool:
        return bool(self.key)


@dataclass(frozen=True)
class Manual:
    """Work that only an operator can finish, with the statement that would do it."""

    kind: str
    table: str
    name: str
    sql: str
    reason: str


@dataclass
class Finding:
    severity: str  # issue or warning
    table: str
    column: str
    kind: str
    n: int
    message: str


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)
    manual: list[Manual] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)

    @property
    def issues(self) -> int:
        return sum(f.severity == "issue" for f in self.findings)
