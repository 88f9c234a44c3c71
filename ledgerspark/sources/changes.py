"""A folder's change log as a streaming source: the offset is the log's cursor, and deletions come as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, is_file boolean, deleted boolean, bytes long"
#: Pages of the log that one micro-batch takes at most; their entries (not their files) pass through the driver.
PAGES = 50


class ChangeLog(Protocol):
    """What a folder's service offers."""

    def page(self, cursor: str) -> tuple[list[dict], str, bool]:
        """Entries (path, is_file, deleted, bytes; missing ones are null, deleted false) after a cursor ("" at the beginning), the cursor
        after them, and whether there are more. The same cursor always gives the entries that followed it, or more of them."""


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, log: ChangeLog, pages: int):
        self.log, self.pages = log, pages

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"cursor": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, cursor = [], start["cursor"]
        for _ in range(self.pages):
            entries, cursor, more = self.log.page(cursor)
            rows += map(_row, entries)
            if not more:
                break
        return iter(rows), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802 - Spark's name
        """What a micro-batch had that is run again: the pages up to the one that ends at its cursor."""
        cursor = start["cursor"]
        while cursor != end["cursor"]:
            entries, after, more = self.log.page(cursor)
            if after != end["cursor"] and (not more or after == cursor):
                raise ValueError(f"the log doesn't lead from {start['cursor']!r} to {end['cursor']!r} any more")
            yield from map(_row, entries)
            cursor = after


def _row(entry: dict) -> tuple:
    return entry.get("path"), entry.get("is_file"), bool(entry.get("deleted")), entry.get("bytes")


def read_changes(spark: SparkSession, make: Callable[[], ChangeLog], name: str = "folder_changes", pages: int = PAGES) -> DataFrame:
    """A stream of SCHEMA from the log that make() gives; make is pickled. The query's checkpoint has the cursor: started again it goes on
    after the last micro-batch that was committed, and repeats one that wasn't, with the same entries."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802, ANN001 - Spark's name
            return _Reader(make(), pages)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()
