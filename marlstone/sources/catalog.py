"""Tables by name: fixed schemas, an ordered list of immutable data folders, deferred deletion.

The catalog is one JSON document, written whole and renamed into place, so a reader or a crash sees
the old or the new one. Only its owner (one driver process) writes it; a lock guards its threads. A
table is data folders in the order they were added; folders that aren't listed don't exist, which
makes a failed load invisible. Pins keep the folders of a dropped table until the last reader is done.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from marlstone.sources.fs import Files
from marlstone.types import FILE, INT64, ROW, VARCHAR, Column


class CatalogError(ValueError):
    """Problems of a request: a list of (message, context)."""

    def __init__(self, problems: list[tuple[str, str | None]]):
        super().__init__("; ".join(p for p, _ in problems))
        self.problems = problems


class TableMissing(KeyError):
    pass


@dataclass
class Table:
    table_id: str
    name: str
    columns: list[Column]
    data_files: list[str] = field(default_factory=list)
    created_at: float = 0.0


@dataclass(frozen=True)
class Snapshot:
    """What a query reads: later loads and drops don't change it."""

    table_id: str
    columns: tuple[Column, ...]
    data_files: tuple[str, ...]


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self._files, self._lock = root.rstrip("/"), Files(spark), threading.RLock()
        self._pins: dict[str, set[str]] = {}
        self._tables: dict[str, Table] = {}
        self._pending: dict[str, list[str]] = {}  # dropped tables whose folders are still there
        self._files.mkdirs(f"{self.root}/tables")
        if self._files.exists(self._document):
            state = json.loads(self._files.read(self._document))
            for t in state["tables"]:
                self._tables[t["table_id"]] = Table(**{**t, "columns": [Column(**c) for c in t["columns"]]})
            self._pending = state["pending"]
        for table_id in list(self._pending):  # readers of an earlier process are gone
            self._purge(table_id)

    @property
    def _document(self) -> str:
        return f"{self.root}/catalog.json"

    def _save(self) -> None:
        state = {"tables": [asdict(t) for t in self._tables.values()], "pending": self._pending}
        self._files.replace(self._document, json.dumps(state, indent=1).encode())

    def list_tables(self) -> list[tuple[str, str]]:
        with self._lock:
            return [(t.table_id, t.name) for t in sorted(self._tables.values(), key=lambda t: (t.created_at, t.name))]

    def get(self, table_id: str) -> Table:
        with self._lock:
            if table_id not in self._tables:
                raise TableMissing(table_id)
            return self._tables[table_id]

    def find(self, name: str) -> Table | None:
        with self._lock:
            return next((t for t in self._tables.values() if t.name == name), None)

    def exists(self, name: str) -> bool:
        return self.find(name) is not None

    def create(self, name: str, columns: list[Column]) -> str:
        problems: list[tuple[str, str | None]] = []
        if not name:
            problems.append(("Table name cannot be empty", "name"))
        if not columns:
            problems.append(("Table must have at least one column", "columns"))
        for i, c in enumerate(columns):
            if not c.name:
                problems.append(("Column name cannot be empty", f"columns[{i}]"))
            elif c.name in (ROW, FILE):
                problems.append((f"Column name '{c.name}' is reserved", f"columns[{i}]"))
            if c.type not in (INT64, VARCHAR):
                problems.append((f"Unknown column type '{c.type}'", f"columns[{i}]"))
        if problems:
            raise CatalogError(problems)
        with self._lock:
            if self.exists(name):
                raise CatalogError([(f"Table '{name}' already exists", "name")])
            seen: set[str] = set()
            for i, c in enumerate(columns):
                if c.name in seen:
                    raise CatalogError([(f"Duplicate column name '{c.name}'", f"columns[{i}]")])
                seen.add(c.name)
            table = Table(str(uuid.uuid4()), name, list(columns), created_at=time.time())
            self._files.mkdirs(f"{self.root}/tables/{table.table_id}")
            self._tables[table.table_id] = table
            self._save()
            return table.table_id

    def drop(self, table_id: str) -> None:
        """Gone at once for new queries; the files go with the last pin."""
        with self._lock:
            table = self.get(table_id)
            del self._tables[table_id]
            self._pending[table_id] = table.data_files
            self._save()
            if not self._pins.get(table_id):
                self._purge(table_id)

    def _purge(self, table_id: str) -> None:
        self._files.delete(f"{self.root}/tables/{table_id}")
        del self._pending[table_id]
        self._save()

    def new_data_path(self, table_id: str) -> str:
        return f"{self.root}/tables/{table_id}/{uuid.uuid4()}.parquet"

    def add_data(self, table_id: str, path: str) -> None:
        """The commit point of a load."""
        with self._lock:
            self.get(table_id).data_files.append(path)
            self._save()

    def snapshot(self, table_id: str) -> Snapshot:
        with self._lock:
            t = self.get(table_id)
            return Snapshot(table_id, tuple(t.columns), tuple(t.data_files))

    def pin(self, table_id: str, reader: str) -> None:
        with self._lock:
            self.get(table_id)
            self._pins.setdefault(table_id, set()).add(reader)

    def unpin(self, table_id: str, reader: str) -> None:
        with self._lock:
            pins = self._pins.get(table_id, set())
            pins.discard(reader)
            if not pins:
                self._pins.pop(table_id, None)
                if table_id in self._pending:
                    self._purge(table_id)

    @contextmanager
    def pinned(self, table_id: str):
        reader = uuid.uuid4().hex
        self.pin(table_id, reader)
        try:
            yield
        finally:
            self.unpin(table_id, reader)

    def is_pending_deletion(self, table_id: str) -> bool:
        with self._lock:
            return table_id in self._pending

    def active_pins(self, table_id: str) -> int:
        with self._lock:
            return len(self._pins.get(table_id, ()))
