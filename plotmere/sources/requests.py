"""A Python data source of recorded answers: one partition for each planned request, so a failed one is read again alone.

    spark.dataSource.register(RecordedAnswers)
    spark.read.format("recorded_answers").option("folder", "...").option("phrases", "a,b").option("cells", 7).load()

An answer of (phrase, cell, page) is folder/phrase-cell-page.json; pages follow each other until one is absent. A reader
of a live service takes the place of ``_fetch``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Request(InputPartition):
    def __init__(self, phrase: str, cell: int):
        self.phrase, self.cell = phrase, cell


class RecordedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return "phrase string, cell int, page int, answer string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.pages = options["folder"], int(options.get("pages", 3))
        self.requests = [(p, c) for c in range(int(options.get("cells", 1))) for p in options["phrases"].split(",")]

    def partitions(self) -> list[Request]:
        return [Request(*r) for r in self.requests]

    def _fetch(self, request: Request, page: int) -> str | None:
        path = f"{self.folder}/{request.phrase}-{request.cell}-{page}.json"
        fs, path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        if fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with fs.open_input_stream(path) as f:
            return f.read().decode()

    def read(self, partition: Request) -> Iterator[tuple]:
        for page in range(self.pages):
            answer = self._fetch(partition, page)
            if answer is None:
                return
            yield partition.phrase, partition.cell, page, answer
