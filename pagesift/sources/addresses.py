"""A Spark data source of URLs, for plugins that name what to crawl: ``spark.read.format("pagesift-urls")``.

Options: ``urls``, addresses parted by white space, or ``pattern`` with ``count``, where {n} stands for 1 up to the count;
``partitions``, in how many parts the executors read. Every partition makes its own addresses; none pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class AddressSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagesift-urls"

    def schema(self) -> str:
        return "url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.listed = list(dict.fromkeys(options.get("urls", "").split()))
        self.pattern, self.count = options.get("pattern"), int(options.get("count", "0"))
        self.parts = max(1, int(options.get("partitions", "1")))
        if self.pattern and "{n}" not in self.pattern:
            raise ValueError("the pattern has no {n}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in self.listed[partition.value :: self.parts]:
            yield (url,)
        if self.pattern:
            for n in range(1 + partition.value, self.count + 1, self.parts):
                yield (self.pattern.replace("{n}", str(n)),)


def register(spark) -> None:
    spark.dataSource.register(AddressSource)
