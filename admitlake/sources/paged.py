"""A paged source of records: one partition per page, read where the task runs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(page, size) -> (status, seconds to wait, records); a JSON-ready dict per record.
Fetch = Callable[[int, int], tuple[int, float, list[dict]]]


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


def paged_source(name: str, fetch: Fetch, total: int, size: int = 100, tries: int = 3) -> type[DataSource]:
    """A data source to register with spark.dataSource.register: page (long) and record (JSON text) of total // size + 1 pages.

    A page answered by 429 is asked for again after the wait it names; one that fails `tries` times gives one row with a null
    record, so that a result says which pages it lacks.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[Page]:
            return [Page(k) for k in range(total // size + 1)]

        def read(self, partition: Page) -> Iterator[tuple]:
            for _ in range(tries):
                status, wait, records = fetch(partition.value, size)
                if status == 200:
                    yield from ((partition.value, json.dumps(r)) for r in records)
                    return
                time.sleep(wait if status == 429 else 0)
            yield partition.value, None

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page long, record string"

        def reader(self, schema) -> Reader:
            return Reader()

    return Source
