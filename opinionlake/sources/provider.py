"""A pluggable item source: files saved by a collector, read as a Spark data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEM_SCHEMA = (
    "source string, content_type string, source_item_id string, content_hash string, text string, source_url string, title string, board string, "
    "thread_source_id string, parent_source_id string, author_hash string, rating bigint, relative_date string, published_at string, "
    "date_precision string, owner_reply string"
)
FIELDS = [f.split()[0] for f in ITEM_SCHEMA.split(", ")]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SavedItems(DataSource):
    """``spark.read.format("saved_items").load(folder)``: JSON lines, one partition per file.

    A new source subclasses this and overrides ``records`` to turn one saved file into items.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_items"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SavedItemsReader(self.options["path"], self.records)

    @staticmethod
    def records(lines: Iterator[str]) -> Iterator[dict]:
        for line in lines:
            if line.strip():
                yield json.loads(line)


class _SavedItemsReader(DataSourceReader):
    def __init__(self, path: str, records):
        self.path, self.records = path, records

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        import io

        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path) as raw:
            for record in self.records(io.TextIOWrapper(raw, encoding="utf-8")):
                yield tuple(record.get(f) for f in FIELDS)


def register(spark: SparkSession, source=SavedItems) -> None:
    spark.dataSource.register(source)
