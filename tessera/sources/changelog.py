"""A change log as a data source of Spark: read after a cursor, in batches and as a stream.

A change has a time and an id; its place in the log is the pair. The log is parquet files of a folder (or one file), whose
row groups carry the least and the largest time. A row group is a partition of a read; filters on time and id, and the
cursor, leave out whole row groups by these, and rows inside the others (Spark prunes no columns of such a source). A change that comes later than
others behind it in the log is not seen by a cursor that has passed it. The stream's offset is the cursor itself, so a
query that is resumed goes on after the last change that it was given. Files are opened by their URI through pyarrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

#: Comparisons that a read takes over from Spark.
_TAKEN = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, EqualTo: pc.equal}
START = {"at": None, "key": None}


@dataclass
class Part(InputPartition):
    """A row group, with the cursors between which its changes are wanted: after one, up to the other."""

    path: str
    group: int
    after: dict | None = None
    upto: dict | None = None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    # Spark's file:/x is no URI to pyarrow
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path) if ":" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, where = _opened(path)
    if system.get_file_info(where).type == fs.FileType.File:
        return [where]
    found = system.get_file_info(fs.FileSelector(where, recursive=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


def _plain(value: object) -> object:
    """Times in UTC, without a zone."""
    return value.astimezone(UTC).replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value


def _micros(value: object) -> int | None:
    """A time as microseconds since 1970."""
    if isinstance(value, datetime):
        delta = _plain(value) - datetime(1970, 1, 1)
        return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return value if value is None else int(value)


class _Log:
    """The row groups of a log and what their statistics say."""

    def __init__(self, options: dict[str, str]):
        self.path, self.at, self.key = options["path"], options.get("at", "at"), options.get("key", "id")

    def schema(self) -> pa.Schema:
        system, _ = _opened(self.path)
        files = _files(self.path)
        if not files:
            raise ValueError(f"no parquet file in {self.path}")
        return pq.read_schema(files[0], filesystem=system)

    def groups(self) -> Iterator[tuple[str, int, dict[str, tuple[object, object] | None]]]:
        """File, number and, by column, the least and the largest value (None: not known)."""
        system, _ = _opened(self.path)
        for file in _files(self.path):
            meta = pq.read_metadata(file, filesystem=system)
            for g in range(meta.num_row_groups):
                group, ranges = meta.row_group(g), {}
                for c in range(group.num_columns):
                    column = group.column(c)
                    if column.path_in_schema in (self.at, self.key):
                        s = column.statistics
                        ranges[column.path_in_schema] = (s.min, s.max) if s is not None and s.has_min_max else None
                yield file, g, ranges

    def table(self, part: Part, columns: list[str] | None = None) -> pa.Table:
        system, _ = _opened(self.path)
        with pq.ParquetFile(part.path, filesystem=system) as file:
            return file.read_row_group(part.group, columns=columns)

    def behind(self, table: pa.Table, cursor: dict) -> pa.ChunkedArray:
        """Which changes come after the cursor."""
        at, key = self._times(table), table.column(self.key)
        same = pc.and_(pc.equal(at, cursor["at"]), pc.greater(key, pa.scalar(cursor["key"], key.type)))
        return pc.fill_null(pc.or_(pc.greater(at, cursor["at"]), same), False)

    def _times(self, table: pa.Table) -> pa.ChunkedArray:
        at = table.column(self.at)
        return at.cast(pa.timestamp("us", tz=at.type.tz)).cast(pa.int64()) if pa.types.is_timestamp(at.type) else at.cast(pa.int64())

    def last(self) -> dict:
        """The cursor of the last change: only the row groups that reach the largest time are looked into."""
        groups = list(self.groups())
        tops = [r[self.at][1] for *_, r in groups if r.get(self.at)]
        best = (None, None)
        for file, g, ranges in groups:
            if ranges.get(self.at) and ranges[self.at][1] < max(tops):
                continue
            table = self.table(Part(file, g), [self.at, self.key])
            at = self._times(table)
            top = pc.max(at).as_py()
            if top is not None and (best[0] is None or top >= best[0]):
                key = pc.max(table.column(self.key).filter(pc.equal(at, top))).as_py()
                best = max(best, (top, key)) if best[0] == top else (top, key)
        return {"at": best[0], "key": best[1]}

    def parts(self, after: dict | None, upto: dict | None) -> list[Part]:
        """Row groups that can hold changes after one cursor and up to the other."""
        out = []
        for file, g, ranges in self.groups():
            low, high = map(_micros, ranges.get(self.at) or (None, None))
            if after and after["at"] is not None and high is not None and high < after["at"]:
                continue
            if upto and (upto["at"] is None or (low is not None and low > upto["at"])):
                continue
            out.append(Part(file, g, after, upto))
        return out

    def rows(self, part: Part) -> pa.Table:
        table = self.table(part)
        if part.after and part.after["at"] is not None:
            table = table.filter(self.behind(table, part.after))
        if part.upto:
            table = table.filter(pc.invert(self.behind(table, part.upto)))
        return table


class ChangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.log, self.filters = _Log(options), []
        self.after = {"at": int(options["afterat"]), "key": int(options["afterkey"])} if "afterat" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TAKEN and len(f.attribute) == 1 and f.attribute[0] in (self.log.at, self.log.key):
                self.filters.append(f)
            else:
                yield f

    def _possible(self, ranges: dict) -> bool:
        for f in self.filters:
            low, high = ranges.get(f.attribute[0]) or (None, None)
            value = f.value
            if low is None:
                continue
            low, high, value = map(_plain, (low, high, value))
            above = {GreaterThan: high <= value, GreaterThanOrEqual: high < value, LessThan: low >= value, LessThanOrEqual: low > value, EqualTo: not low <= value <= high}
            if above[type(f)]:
                return False
        return True

    def partitions(self) -> list[Part]:
        ranges = {(file, g): r for file, g, r in self.log.groups()}
        return [p for p in self.log.parts(self.after, None) if self._possible(ranges[p.path, p.group])]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions
            return
        table = self.log.rows(partition)
        for f in self.filters:
            column = table.column(f.attribute[0])
            if pa.types.is_timestamp(column.type):
                column = column.cast(pa.timestamp("us"))
            table = table.filter(pc.fill_null(_TAKEN[type(f)](column, pa.scalar(_plain(f.value), column.type)), False))
        yield from table.to_batches(max_chunksize=10_000)


class ChangeStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.log = _Log(options)

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        return self.log.last()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.log.parts(start, end)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.log.rows(partition).to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        pass


class ChangeLog(DataSource):
    """format("changes"): options path, at and key (the columns of the cursor), afterAt (microseconds) and afterKey (batch reads only: the cursor to go on from)."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self):
        return from_arrow_schema(_Log(self.options).schema(), prefer_timestamp_ntz=True)

    def reader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)

    def streamReader(self, schema) -> ChangeStream:
        return ChangeStream(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format and pushes filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChangeLog)
    return spark
