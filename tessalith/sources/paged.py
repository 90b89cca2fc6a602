"""A paged service as a Spark data source: one partition a page, read by the executors.

``spark.read.format("paged").option("call", "package.module:function")`` asks
``function(skip, limit)`` for a status and a list of JSON objects; options
``page`` and ``most`` say how many at once and in all.  400, 404 and an empty
page have no rows.  The first page decides: without a row there, or with
trouble on the line, it is an error; later pages that fail have no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessalith.functions.text import split_name
from tessalith.schemas import DRUG_RECORD


class Page(InputPartition):
    def __init__(self, skip: int):
        self.skip = skip


class Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.call, self.page, self.most = options["call"], int(options.get("page", 1000)), int(options.get("most", 25_000))

    def partitions(self) -> list[Page]:
        return [Page(skip) for skip in range(0, self.most, self.page)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        module, name = self.call.split(":")
        first = partition.skip == 0
        try:
            status, records = getattr(import_module(module), name)(partition.skip, self.page)
        except OSError:
            if first:
                raise
            return
        if status >= 300 and status not in (400, 404):
            raise RuntimeError(f"HTTP {status}")
        if status in (400, 404) or not records:
            if first:
                raise RuntimeError("the service returned no record")
            return
        for record in records:
            yield (json.dumps(record),)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> Pages:
        return Pages(self.options)


def read_records(spark: SparkSession, call: str, page: int = 1000, most: int = 25_000) -> DataFrame:
    """Product records of the service; what does not parse comes out null."""
    spark.dataSource.register(PagedSource)
    raw = spark.read.format("paged").option("call", call).option("page", page).option("most", most).load()
    return raw.select(F.from_json("record", DRUG_RECORD).alias("r")).select("r.*")


def generic_and_brand_only(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term) of generic names, and of brand names that are no generic name."""
    generic = records.select(F.explode(split_name(F.col("generic_name"))).alias("term")).distinct()
    brand = records.select(F.explode(split_name(F.col("brand_name"))).alias("term")).distinct()
    return generic, brand.join(generic, "term", "left_anti")
