"""Target DDL as text, and the work that is left to people."""

from __future__ import annotations

from ..functions.names import bounded_name, check_identifier, hashed_name, literal, quote
from ..functions.typemap import Unsupported, default_sql, enum_labels, parts, target_type
from ..model import Column, Index, Manual, Table


def enum_name(table: str, column: str) -> str:
    return hashed_name(f"{table}_{column}_enum", f"{table}.{column}")


def key_name(table: str) -> str:
    return bounded_name(f"{table}_pkey", f"{table}.pkey")


def index_name(table: str, index: str) -> str:
    return hashed_name(f"{table}_{index}", f"{table}.{index}")


def enum_sql(schema: str, table: str, c: Column, markers: int = 0) -> str:
    """CREATE TYPE; the empty label comes first if rows hold it and the source doesn't declare it."""
    labels = enum_labels(c.type)
    if not labels:
        raise Unsupported(f"malformed enum {c.type!r} of {table}.{c.name}")
    if markers and "" not in labels:
        labels = ["", *labels]
    return f"CREATE TYPE {quote(schema)}.{quote(enum_name(table, c.name))} AS ENUM ({', '.join(map(literal, labels))});"


def column_sql(c: Column, table: str, schema: str = "public", demoted: bool = False) -> str:
    target = target_type(c, f"{quote(schema)}.{quote(enum_name(table, c.name))}", demoted)
    out = [quote(check_identifier(c.name)), target]
    extra = c.extra.lower()
    if not c.nullable:
        out.append("NOT NULL")
    if "on update" in extra and "on update current_timestamp" not in extra:
        raise Unsupported(f"{table}.{c.name}: {c.extra}")
    if c.generation:
        return " ".join(out)
    if "auto_increment" in extra:
        if target not in {"SMALLINT", "INTEGER", "BIGINT"}:
            raise Unsupported(f"{table}.{c.name}: auto_increment on {target}")
        return " ".join([*out, "GENERATED BY DEFAULT AS IDENTITY"])
    if (default := default_sql(c, target)) is not None:
        out.append(f"DEFAULT {default}")
    return " ".join(out)


def create_table_sql(t: Table, schema: str = "public", demoted: frozenset | set = frozenset()) -> str:
    cols = ",\n  ".join(column_sql(c, t.name, schema, c.name in demoted) for c in t.columns)
    return f"CREATE TABLE IF NOT EXISTS {quote(schema)}.{quote(check_identifier(t.name))} (\n  {cols}\n);"


def primary_key_sql(t: Table, schema: str = "public") -> str:
    return f"ALTER TABLE {quote(schema)}.{quote(t.name)} ADD CONSTRAINT {quote(key_name(t.name))} PRIMARY KEY ({', '.join(map(quote, t.key))});"


def same_key(a, b) -> bool:
    """Equal lists of identifiers, in order, but for case."""
    return [x.lower() for x in a] == [x.lower() for x in b]


def comment_sql(t: Table, schema: str = "public") -> list[str]:
    at = f"{quote(schema)}.{quote(t.name)}"
    out = [f"COMMENT ON TABLE {at} IS {literal(t.comment)};"] if t.comment else []
    return out + [f"COMMENT ON COLUMN {at}.{quote(c.name)} IS {literal(c.comment)};" for c in t.columns if c.comment]


def index_sql(t: Table, ix: Index, schema: str = "public") -> str:
    """BTREE only; a prefix becomes an expression, a direction stays."""
    if ix.method.upper() != "BTREE":
        raise Unsupported(f"index {ix.name} of {t.name}: method {ix.method}")
    cols = []
    for name, prefix, desc in ix.columns:
        text = f"(substring({quote(name)} FROM 1 FOR {prefix}))" if prefix else quote(name)
        cols.append(text + (" DESC" if desc else " ASC"))
    return f"CREATE {'UNIQUE ' * ix.unique}INDEX IF NOT EXISTS {quote(index_name(t.name, ix.name))} ON {quote(schema)}.{quote(t.name)} ({', '.join(cols)});"


def on_update_manual(t: Table, schema: str = "public") -> list[Manual]:
    """A trigger for each column that the source sets on every update."""
    out = []
    for c in t.columns:
        if "on update current_timestamp" in c.extra.lower():
            fn = hashed_name(f"{t.name}_{c.name}_touch", f"{t.name}.{c.name}.touch")
            sql = (
                f"CREATE FUNCTION {quote(schema)}.{quote(fn)}() RETURNS trigger AS $$ BEGIN NEW.{quote(c.name)} := CURRENT_TIMESTAMP; RETURN NEW; END $$ LANGUAGE plpgsql;\n"
                f"CREATE TRIGGER {quote(fn)} BEFORE UPDATE ON {quote(schema)}.{quote(t.name)} FOR EACH ROW EXECUTE FUNCTION {quote(schema)}.{quote(fn)}();"
            )
            out.append(Manual("on_update", t.name, c.name, sql, "the source sets this column on every update"))
    return out


def generated_manual(t: Table, schema: str = "public") -> list[Manual]:
    """Generated columns are loaded as plain values; the statement restores the rule, in the cast's type if there is one."""
    return [
        Manual("generated", t.name, c.name, f"ALTER TABLE {quote(schema)}.{quote(t.name)} DROP COLUMN {quote(c.name)}, ADD COLUMN {quote(c.name)} {target_type(c, 'TEXT')} GENERATED ALWAYS AS ({c.generation}) STORED;", "translate the expression, then run")
        for c in t.columns
        if c.generation
    ]


def report_only(kind: str, names: list[str], table: str = "") -> list[Manual]:
    """Triggers, functions and views are named, never translated."""
    return [Manual(kind, table, n, "", f"rewrite this {kind} for the target") for n in names]


def plain_type(type_text: str) -> str:
    return parts(type_text)[0]


def write_manual(items: list[Manual], path: str) -> None:
    """All manual work in one file that only its owner reads."""
    import os

    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        for m in items:
            f.write(f"-- {m.kind}: {m.table}{'.' * bool(m.table)}{m.name}: {m.reason}\n{m.sql}\n\n")
