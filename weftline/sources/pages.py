"""A paged index as a Spark data source: one partition per page, pages end with a short one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagePartition(InputPartition):
    def __init__(self, page: int) -> None:
        super().__init__(page)
        self.page = page


class PagedIndex(DataSource):
    """Reads ``page-N.json`` files of a folder (a local stand-in for a paged service); options ``path`` and ``size``."""

    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("size", "50"))

    def partitions(self) -> list[InputPartition]:
        pages = []
        for n in range(len(list(Path(self.path).glob("page-*.json")))):
            pages.append(PagePartition(n))
            if len(json.loads((Path(self.path) / f"page-{n}.json").read_text())) < self.size:
                break
        return pages

    def read(self, partition: PagePartition) -> Iterator[tuple[int, str]]:
        for item in json.loads((Path(self.path) / f"page-{partition.page}.json").read_text()):
            yield partition.page, json.dumps(item)
