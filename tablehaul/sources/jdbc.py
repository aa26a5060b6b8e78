"""JDBC tables: catalogs, parallel reads by key ranges, checked appends, retries on connect."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Column, ForeignKey, Index, Table


def mysql_url(host: str, port: int, database: str, compression: bool = True, **options: str) -> str:
    """Wire compression is on unless told otherwise; options are added in order."""
    opts = {"useCompression": str(bool(compression)).lower(), **options}
    return f"jdbc:mysql://{host}:{port}/{quote_plus(database)}?" + "&".join(f"{k}={quote_plus(v)}" for k, v in opts.items())


def postgres_url(host: str, port: int, database: str, sslmode: str = "prefer", **options: str) -> str:
    opts = {"sslmode": sslmode, **options}
    return f"jdbc:postgresql://{host}:{port}/{quote_plus(database)}?" + "&".join(f"{k}={quote_plus(v)}" for k, v in opts.items())


#: Speeds up a bulk load's session without weakening what a commit means.
SESSION_TUNING = "SET maintenance_work_mem = '256MB'; SET work_mem = '64MB'"


def literal(v) -> str:
    if v is None:
        raise ValueError("a key range can't end in null")
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def range_predicates(key: str, ranges: Sequence[tuple[object, object]], q: str = '"') -> list[str]:
    """One WHERE text for each range (low, high], open at None: one partition each. Null keys belong to the first."""
    name = q + key.replace(q, q * 2) + q
    out = []
    for low, high in ranges:
        held = [f"{name} {op} {literal(v)}" for op, v in ((">", low), ("<=", high)) if v is not None]
        if low is None and held:
            held = [f"({held[0]} OR {name} IS NULL)"]
        out.append(" AND ".join(held) or "1 = 1")
    return out


#: How a driver's metadata number the rules for deleted parents.
DELETE = {"0": "CASCADE", "1": "RESTRICT", "2": "SET NULL", "3": "NO ACTION", "4": "SET DEFAULT"}


def sql_type(kind: str, size: str | None, digits: str | None) -> str:
    """A type's text from the parts that a driver's metadata give."""
    base = kind.lower()
    if base in {"varchar", "char", "varbinary", "binary"}:
        return f"{base}({size})"
    if base in {"decimal", "numeric"}:
        return f"decimal({size},{digits or 0})"
    return {"integer": "int", "timestamp": "datetime", "clob": "longtext", "long varchar": "longtext", "real": "float", "boolean": "tinyint(1)"}.get(base, base)


class JdbcSource:
    """Each partition has its own connection, so one consistent view across partitions needs a source that stands still.

    Tables, columns, keys and indexes are read from the driver's metadata for ``schema`` (a catalog in MySQL): rows of
    a catalog, never of a table.
    """

    def __init__(self, spark: SparkSession, url: str, driver: str | None = None, fetch: int = 5000, schema: str | None = None, **properties: str):
        self.spark, self.url, self.schema, self.known = spark, url, schema, set()
        self.properties = {"fetchsize": str(fetch), **({"driver": driver} if driver else {}), **properties}

    def metadata(self, ask: Callable[[object, str | None, str | None], object], columns: Sequence[str]) -> list[tuple]:
        """Rows of what ``ask`` (metadata, catalog, schema) gives, by column name."""
        jvm = self.spark._jvm
        if driver := self.properties.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        props = jvm.java.util.Properties()
        for k, v in self.properties.items():
            props.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, props)
        try:
            place = (self.schema, None) if self.quote == "`" else (None, self.schema)
            found, out = ask(connection.getMetaData(), *place), []
            while found.next():
                out.append(tuple(found.getString(c) for c in columns))
            return out
        finally:
            connection.close()

    def list_tables(self) -> list[str]:
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        self.known = {n for (n,) in self.metadata(lambda m, c, s: m.getTables(c, s, "%", kinds), ["TABLE_NAME"])}
        return sorted(self.known)

    def table(self, name: str) -> Table:
        """A table by its exact name; ``%`` and ``_`` of names are no wildcards."""
        cols = self.metadata(lambda m, c, s: m.getColumns(c, s, "%", "%"), ["TABLE_NAME", "ORDINAL_POSITION", "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "NULLABLE", "COLUMN_DEF", "IS_AUTOINCREMENT", "REMARKS"])
        mine = sorted((r for r in cols if r[0] == name), key=lambda r: int(r[1]))
        columns = tuple(Column(c, sql_type(kind, size, digits), null != "0", None if auto == "YES" else default, "auto_increment" if auto == "YES" else "", comment=remarks or "") for _, _, c, kind, size, digits, null, default, auto, remarks in mine)
        key = sorted((int(i), c) for c, i in self.metadata(lambda m, c, s: m.getPrimaryKeys(c, s, name), ["COLUMN_NAME", "KEY_SEQ"]))
        fks: dict[str, list] = {}
        for fk, i, c, parent, pc, rule in self.metadata(lambda m, c, s: m.getImportedKeys(c, s, name), ["FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME", "DELETE_RULE"]):
            fks.setdefault(fk, []).append((int(i), c, parent, pc, rule))
        foreign = []
        for fk, parts in sorted(fks.items()):
            parts.sort()
            foreign.append(ForeignKey(fk, name, tuple(p[1] for p in parts), parts[0][2], tuple(p[3] for p in parts), DELETE.get(parts[0][4], "NO ACTION")))
        return Table(name, columns, tuple(c for _, c in key), foreign_keys=tuple(foreign), indexes=self.indexes(name, [c for _, c in key], [list(f.columns) for f in foreign]))

    def indexes(self, name: str, key: list[str], foreign: list[list[str]]) -> tuple[Index, ...]:
        """Indexes by their columns' order, but for those that stand for the primary key or, not unique, a foreign key."""
        parts: dict[str, list] = {}
        for ix, i, c, order, free in self.metadata(lambda m, c, s: m.getIndexInfo(c, s, name, False, True), ["INDEX_NAME", "ORDINAL_POSITION", "COLUMN_NAME", "ASC_OR_DESC", "NON_UNIQUE"]):
            if ix and c:
                parts.setdefault(ix, []).append((int(i), c, order == "D", free.lower() in {"0", "false", "f"}))
        out = []
        for ix, cols in sorted(parts.items()):
            cols.sort()
            names, unique = [c[1] for c in cols], cols[0][3]
            if not (unique and names == key) and (unique or names not in foreign):
                out.append(Index(ix, tuple((c, None, down) for _, c, down, _ in cols), unique))
        return tuple(out)

    def tables(self) -> list[Table]:
        return [self.table(n) for n in self.list_tables()]

    def version(self) -> str:
        """Rows of each table, counted side by side in one job: a source that gains or loses rows in a run is found out."""
        names = self.list_tables()
        if not names:
            return ""
        one = [self.read(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n") for n in names]
        return repr(sorted(map(tuple, reduce(DataFrame.unionByName, one).collect())))  # a row a table

    def named(self, table: str) -> str:
        """A name as the source's SQL quotes it, with its schema."""
        q = self.quote
        return ".".join(q + n.replace(q, q * 2) + q for n in (self.schema, table) if n)

    @property
    def quote(self) -> str:
        """What names are quoted with: in MySQL double quotes make a text."""
        return "`" if self.url.lower().startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """``table`` as SQL text, or by its exact name once ``list_tables`` found it."""
        df = self.spark.read.jdbc(self.url, self.named(table) if table in self.known else table, properties=self.properties)
        return df.select(*columns) if columns else df

    def read_ranges(self, table: str, key: str, ranges: Sequence[tuple[object, object]]) -> DataFrame:
        return self.spark.read.jdbc(self.url, table, predicates=range_predicates(key, ranges, self.quote), properties=self.properties)

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.properties).load()

    def append(self, df: DataFrame, table: str, batch: int = 1000) -> None:
        df.write.option("batchsize", batch).jdbc(self.url, table, mode="append", properties=self.properties)

    def checked_append(self, df: DataFrame, table: str, batch: int = 1000) -> int:
        """Rows appended, as counted in the pass that wrote them and again in the target."""
        from pyspark.sql import Observation

        before, seen = self.read(table).count(), Observation()
        self.append(df.observe(seen, F.count(F.lit(1)).alias("n")), table, batch)
        if (now := self.read(table).count()) - before != seen.get["n"]:
            raise RuntimeError(f"{table}: {seen.get['n']} rows sent, {now - before} arrived")
        return seen.get["n"]


def with_retry(connect: Callable[[], object], attempts: int = 30, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Calls ``connect`` until it succeeds; the last failure is raised."""
    for i in range(attempts):
        try:
            return connect()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(wait)


def prefer_ssl(connect: Callable[[str], object]):
    """With TLS if the server speaks it, else without."""
    try:
        return connect("require")
    except Exception as e:
        if "ssl" not in str(e).lower():
            raise
        return connect("disable")
