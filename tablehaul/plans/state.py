"""Sessions, checkpoints and events in one small store on the driver: a row for each table, never for data rows."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import threading
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

STATUSES = ("pending", "in_progress", "done", "error")
DDL = """
CREATE TABLE IF NOT EXISTS sessions(id TEXT PRIMARY KEY, connector TEXT, created_at TEXT, updated_at TEXT, deleted_at TEXT);
CREATE TABLE IF NOT EXISTS migrations(id INTEGER PRIMARY KEY, session_id TEXT, table_name TEXT, status TEXT, last_offset INTEGER, row_count INTEGER, error_message TEXT, created_at TEXT, updated_at TEXT, deleted_at TEXT, UNIQUE(session_id, table_name));
CREATE TABLE IF NOT EXISTS session_events(id INTEGER PRIMARY KEY AUTOINCREMENT, session_id TEXT, level TEXT, message TEXT, table_name TEXT, processed_rows INTEGER, total_rows INTEGER, created_at TEXT);
CREATE INDEX IF NOT EXISTS session_events_by_id ON session_events(session_id, id);
"""
#: Columns that stores of earlier versions lack.
ADDED = {"last_cursor": "TEXT NOT NULL DEFAULT ''", "batch_size": "INTEGER NOT NULL DEFAULT 0"}
EVENTS = "id bigint, session_id string, level string, message string, table_name string, processed_rows bigint, total_rows bigint, created_at string"
CHECKPOINTS = "session_id string, table_name string, status string, last_offset bigint, last_cursor string, batch_size bigint, row_count bigint, error_message string, updated_at string"


@dataclass
class Checkpoint:
    session_id: str
    table_name: str
    status: str = "pending"
    last_offset: int = 0
    last_cursor: str = ""
    batch_size: int = 0
    row_count: int = 0
    error_message: str = ""
    updated_at: str = ""


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


class Store:
    def __init__(self, path: str = ":memory:"):
        self.db, self.lock = sqlite3.connect(path, check_same_thread=False), threading.RLock()
        self.db.row_factory = sqlite3.Row
        with self.lock:
            self.db.executescript(DDL)
            have = {r["name"] for r in self.db.execute("PRAGMA table_info(migrations)")}
            for name, kind in ADDED.items():
                if name not in have:
                    self.db.execute(f"ALTER TABLE migrations ADD COLUMN {name} {kind}")
            self.db.commit()

    def _do(self, sql: str, *args) -> list[sqlite3.Row]:
        with self.lock:
            rows = self.db.execute(sql, args).fetchall()
            self.db.commit()
            return rows

    def create_session(self, sid: str, connector: str = "") -> None:
        self._do("INSERT INTO sessions(id, connector, created_at, updated_at) VALUES (?, ?, ?, ?)", sid, connector, now(), now())

    def update_connector(self, sid: str, connector: str) -> None:
        if not self._do("UPDATE sessions SET connector = ?, updated_at = ? WHERE id = ? RETURNING id", connector, now(), sid):
            raise KeyError(sid)

    def session(self, sid: str) -> dict | None:
        return next((dict(r) for r in self._do("SELECT * FROM sessions WHERE id = ?", sid)), None)

    def sessions(self) -> list[dict]:
        return [dict(r) for r in self._do("SELECT * FROM sessions ORDER BY created_at DESC, id DESC")]

    def save(self, c: Checkpoint) -> None:
        """Insert or update on (session, table)."""
        if c.status not in STATUSES:
            raise ValueError(f"status {c.status!r}")
        c.updated_at = now()
        d = asdict(c)
        sets = ", ".join(f"{k} = excluded.{k}" for k in d if k not in ("session_id", "table_name"))
        self._do(f"INSERT INTO migrations({', '.join(d)}, created_at) VALUES ({', '.join('?' * len(d))}, ?) ON CONFLICT(session_id, table_name) DO UPDATE SET {sets}", *d.values(), now())

    def checkpoint(self, sid: str, table: str) -> Checkpoint | None:
        return next((c for c in self.checkpoints(sid) if c.table_name == table), None)

    def checkpoints(self, sid: str | None = None) -> list[Checkpoint]:
        names = ", ".join(Checkpoint.__dataclass_fields__)
        where, args = ("WHERE session_id = ?", (sid,)) if sid is not None else ("", ())
        return [Checkpoint(**dict(r)) for r in self._do(f"SELECT {names} FROM migrations {where} ORDER BY table_name", *args)]

    def append_event(self, sid: str, level: str, message: str, table: str = "", done: int = 0, total: int = 0) -> int:
        return self._do("INSERT INTO session_events(session_id, level, message, table_name, processed_rows, total_rows, created_at) VALUES (?, ?, ?, ?, ?, ?, ?) RETURNING id", sid, level, message, table, done, total, now())[0]["id"]

    def events_after(self, sid: str, last_id: int = 0, n: int = 500) -> list[dict]:
        return [dict(r) for r in self._do("SELECT * FROM session_events WHERE session_id = ? AND id > ? ORDER BY id LIMIT ?", sid, last_id, n)]

    def last_events(self, sid: str, n: int) -> list[dict]:
        """The newest ``n``, oldest first."""
        return [dict(r) for r in self._do("SELECT * FROM session_events WHERE session_id = ? ORDER BY id DESC LIMIT ?", sid, n)][::-1]

    def last_event(self, sid: str) -> dict | None:
        return next((dict(r) for r in self._do("SELECT * FROM session_events WHERE session_id = ? ORDER BY id DESC LIMIT 1", sid)), None)

    def checkpoint_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(c)[k.split()[0]] for k in CHECKPOINTS.split(", ")) for c in self.checkpoints()], CHECKPOINTS)

    def event_frame(self, spark: SparkSession) -> DataFrame:
        rows = self._do("SELECT id, session_id, level, message, table_name, processed_rows, total_rows, created_at FROM session_events ORDER BY id")
        return spark.createDataFrame([tuple(r) for r in rows], EVENTS)

    def dump(self) -> str:
        return json.dumps({"sessions": self.sessions(), "migrations": [asdict(c) for c in self.checkpoints()]})
