"""The two kinds of queries, their wire form and their plans."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from marlstone.sources.catalog import Snapshot


class Status(str, Enum):
    CREATED = "CREATED"
    PLANNING = "PLANNING"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"


@dataclass(frozen=True)
class Copy:
    """Append a CSV file to a table."""

    source: str
    table: str
    columns: tuple[str, ...] | None = None
    header: bool = False

    def wire(self) -> dict:
        out = {"sourceFilepath": self.source, "destinationTableName": self.table, "doesCsvContainHeader": self.header}
        return out | ({"destinationColumns": list(self.columns)} if self.columns is not None else {})


@dataclass(frozen=True)
class Select:
    """Every row of a table."""

    table: str

    def wire(self) -> dict:
        return {"tableName": self.table}


@dataclass(frozen=True)
class CopyPlan:
    table_id: str
    query: Copy


@dataclass(frozen=True)
class SelectPlan:
    snapshot: Snapshot


def parse(body: object) -> Copy | Select:
    """A definition from its wire form; one with the fields of both kinds is a load."""
    if not isinstance(body, dict):
        raise ValueError("a query definition is an object")
    source, table, columns, header = (body.get(k) for k in ("sourceFilepath", "destinationTableName", "destinationColumns", "doesCsvContainHeader"))
    if isinstance(source, str) and isinstance(table, str):
        if columns is not None and not (isinstance(columns, list) and all(isinstance(c, str) for c in columns)):
            raise ValueError("destinationColumns is a list of names")
        if header is not None and not isinstance(header, bool):
            raise ValueError("doesCsvContainHeader is true or false")
        return Copy(source, table, None if columns is None else tuple(columns), bool(header))
    if isinstance(body.get("tableName"), str):
        return Select(body["tableName"])
    raise ValueError("a query definition names a source file and a destination table, or a table")
