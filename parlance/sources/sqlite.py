"""A Spark data source over SQLite key-value files: one partition per file, read-only."""

from __future__ import annotations

import glob
import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def bubbles(db: sqlite3.Connection) -> Iterator[tuple[str, int, str, str, str | None]]:
    """(session, position, role, text, time) of the composer table; of the older item table only if that has none."""
    tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    found = False
    if "cursorDiskKV" in tables:
        for key, value in db.execute("SELECT key, value FROM cursorDiskKV WHERE key LIKE 'composerData:%' ORDER BY key"):
            for row in _messages(str(key).split(":", 1)[1], value):
                found = True
                yield row
    if not found and "ItemTable" in tables:
        for key, value in db.execute("SELECT key, value FROM ItemTable ORDER BY key"):
            yield from _messages(str(key), value)


def _messages(session: str, value: object) -> Iterator[tuple[str, int, str, str, str | None]]:
    try:
        data = json.loads(value)
    except (TypeError, ValueError):
        return
    rows = data if isinstance(data, list) else next((data[k] for k in ("conversation", "bubbles", "messages") if isinstance(data.get(k), list)), []) if isinstance(data, dict) else []
    for i, m in enumerate(rows):
        if isinstance(m, dict):
            text = m.get("text") or m.get("content")
            user = m.get("type") == 1 or m.get("role") == "user"
            if isinstance(text, str) and text.strip():
                yield session, i, "user" if user else "assistant", text, None if m.get("createdAt") is None else str(m["createdAt"])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.path, recursive=True))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        except sqlite3.Error:
            return
        try:
            for row in bubbles(db):
                yield (partition.path, *row)
        except sqlite3.DatabaseError:
            return
        finally:
            db.close()


class CursorSource(DataSource):
    """spark.dataSource.register(CursorSource); spark.read.format("cursor_kv").load("/folder/**/*.vscdb")."""

    @classmethod
    def name(cls) -> str:
        return "cursor_kv"

    def schema(self) -> str:
        return "file string, session_id string, seq int, role string, text string, timestamp string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])
