"""Asynchronous queries: submit, poll, fetch, flush.

A query is validated and pins its table before ``submit`` returns; planning and running happen on a
pool of driver threads, each under its own Spark job group. The result of a SELECT is a DataFrame
over immutable files, not rows: it is computed when fetched, a prefix in order when limited. Its
table stays pinned until the result is flushed. Records of queries live as long as the engine.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.definitions import Copy, CopyPlan, Select, SelectPlan, Status
from marlstone.sources import tables
from marlstone.sources.catalog import Catalog, CatalogError
from marlstone.sources.fs import Files


class QueryMissing(KeyError):
    pass


class NotAvailable(ValueError):
    pass


@dataclass
class Record:
    query_id: str
    definition: Copy | Select
    table_id: str
    status: Status = Status.CREATED
    snapshot: SelectPlan | None = None
    error: str | None = None
    done: Future = field(default_factory=Future)


@dataclass(frozen=True)
class Result:
    """Columns in schema order, each a list of values."""

    row_count: int
    columns: list[list]

    def wire(self) -> list[dict]:
        return [{"rowCount": self.row_count, "columns": self.columns}]


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, threads: int = 8, ingest_root: str | None = None):
        self.spark, self.catalog, self.ingest_root = spark, catalog, ingest_root
        self._pool = ThreadPoolExecutor(threads, "query")
        self._lock = threading.RLock()
        self._queries: dict[str, Record] = {}

    def submit(self, query: Copy | Select) -> str:
        table = self.catalog.find(query.table)
        problems = [] if table else [(f"Table '{query.table}' not found", "destinationTableName" if isinstance(query, Copy) else "tableName")]
        if isinstance(query, Copy):
            if self.ingest_root and not query.source.startswith(self.ingest_root.rstrip("/") + "/") or "/../" in query.source:
                problems.append((f"Source file '{query.source}' is outside the ingest folder", "sourceFilepath"))
            elif not Files(self.spark).exists(query.source):
                problems.append((f"Source file '{query.source}' not found", "sourceFilepath"))
        if problems:
            raise CatalogError(problems)
        record = Record(uuid.uuid4().hex, query, table.table_id)
        self.catalog.pin(table.table_id, record.query_id)
        with self._lock:
            self._queries[record.query_id] = record
        self._pool.submit(inheritable_thread_target(self.spark)(self._run), record)
        return record.query_id

    def _set(self, record: Record, status: Status, error: str | None = None) -> None:
        with self._lock:
            record.status, record.error = status, error

    def _plan(self, record: Record) -> CopyPlan | SelectPlan:
        if isinstance(record.definition, Copy):
            tables.target_columns(self.catalog.get(record.table_id).columns, _names(record.definition))
            return CopyPlan(record.table_id, record.definition)
        return SelectPlan(self.catalog.snapshot(record.table_id))

    def _run(self, record: Record) -> None:
        stage = "Planning"
        try:
            self._set(record, Status.PLANNING)
            plan = self._plan(record)
            stage = "Execution"
            self._set(record, Status.RUNNING)
            if isinstance(plan, CopyPlan):
                self.spark.sparkContext.setJobGroup(record.query_id, f"copy into {plan.query.table}")
                tables.copy_csv(self.spark, self.catalog, plan.table_id, plan.query.source, _names(plan.query), plan.query.header)
                self.catalog.unpin(record.table_id, record.query_id)
            else:
                record.snapshot = plan
            self._set(record, Status.COMPLETED)
        except Exception as e:  # whatever went wrong belongs to this query, not to the engine
            self._set(record, Status.FAILED, f"{stage} failed: {e}")
            self.catalog.unpin(record.table_id, record.query_id)
        finally:
            record.done.set_result(None)

    def list_queries(self) -> list[tuple[str, Status]]:
        with self._lock:
            return [(q.query_id, q.status) for q in self._queries.values()]

    def get(self, query_id: str) -> Record:
        with self._lock:
            if query_id not in self._queries:
                raise QueryMissing(query_id)
            return self._queries[query_id]

    def wait(self, query_id: str, timeout: float | None = None) -> Status:
        record = self.get(query_id)
        wait([record.done], timeout)
        return record.status

    def result_frame(self, query_id: str, limit: int | None = None) -> DataFrame:
        """The rows of a completed SELECT, in order."""
        record = self.get(query_id)
        if isinstance(record.definition, Copy):
            raise NotAvailable("COPY queries have no result")
        with self._lock:
            if record.status != Status.COMPLETED:
                raise NotAvailable(f"Query is {record.status.value}")
            if record.snapshot is None:
                raise NotAvailable("Result is not available for this query")
            snapshot = record.snapshot.snapshot
        return tables.scan(self.spark, snapshot, ordered=True, limit=limit)

    def fetch(self, query_id: str, limit: int | None = None) -> Result:
        """The same rows on the driver, by column."""
        df = self.result_frame(query_id, limit)
        columns: list[list] = [[] for _ in df.columns]
        rows = 0
        for row in df.collect():
            rows += 1
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        return Result(rows, columns)

    def error(self, query_id: str) -> str:
        record = self.get(query_id)
        if record.status != Status.FAILED:
            raise NotAvailable("Query has not failed")
        return record.error or ""

    def flush(self, query_id: str) -> None:
        """Lets go of a result; the query stays completed."""
        record = self.get(query_id)
        with self._lock:
            record.snapshot = None
        self.catalog.unpin(record.table_id, query_id)

    def close(self) -> None:
        self._pool.shutdown(wait=True)


def _names(query: Copy) -> list[str] | None:
    return None if query.columns is None else list(query.columns)
