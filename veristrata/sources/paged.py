"""A Spark data source over paged answers: what a web service gives page by page, each with the token of the next.

``write_pages`` lays a table out that way: one JSON file a page, ``{"rows": [...], "next": token}``. The source ``paged``
reads it in batch, one partition for each page that a list of tokens names, or as a stream whose offset is the token
reached. Network transport stays out: a service's answers enter as files in a folder that all tasks share.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import LongType, StructType

from ..session import numbered


def _read(folder: str, name: str) -> dict:
    """One JSON file of the folder, from any store that the tasks reach."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/{name}.json") as f:
        return json.loads(f.read().decode())


def write_pages(rows: DataFrame, key: str, size: int, folder: str) -> int:
    """Write rows in the order of ``key`` as pages of ``size`` rows; returns the number of pages.

    A page is written by the task that holds it. Tokens are page numbers; the last page has none to follow. A table
    without rows is one page without rows.
    """
    placed = numbered(rows, key).withColumn("page", F.floor(F.col("place") / size))
    pages = max(1, -(-placed.count() // size))
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    texts = placed.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", body.alias("row")))), lambda x: x["row"]), ",").alias("rows"))

    def put(batches: Iterator) -> Iterator:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for page, own in zip(batch.column("page").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                follow = json.dumps(str(page + 1) if page + 1 < pages else None)
                with store.open_output_stream(f"{base}/{page}.json") as f:
                    f.write(f'{{"rows": [{own}], "next": {follow}}}'.encode())
            yield batch.select(["page"])

    filled = texts if pages > 1 or not placed.isEmpty() else rows.sparkSession.createDataFrame([(0, "")], "page long, rows string")
    filled.mapInArrow(put, "page long").count()
    return pages


class PagedReader(DataSourceReader):
    """One partition for each of the pages 0 to ``pages`` - 1."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.folder, self.pages = [f.name for f in schema.fields], options["path"], int(options["pages"])
        self.longs = [isinstance(f.dataType, LongType) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def rows(self, page: dict) -> Iterator[tuple]:
        for row in page["rows"]:
            yield tuple(int(v) if whole and v is not None else v for v, whole in zip((row.get(n) for n in self.names), self.longs, strict=True))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(_read(self.folder, str(partition.value)))


class PagedStream(SimpleDataSourceStreamReader):
    """Pages by the token of the one before; the offset is the token to read next, and stays when no page follows yet."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.own, self.folder = PagedReader(schema, {**options, "pages": "0"}), options["path"]

    def initialOffset(self) -> dict:
        return {"token": "0"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, token = [], start["token"]
        while token is not None:
            try:
                page = _read(self.folder, token)
            except FileNotFoundError:
                break
            rows += self.own.rows(page)
            token = page["next"]
        return iter(rows), {"token": token}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        token = start["token"]
        while token is not None and token != end["token"]:
            page = _read(self.folder, token)
            yield from self.own.rows(page)
            token = page["next"]


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...)`` with options path and, in batch, pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(schema, dict(self.options))


def read_pages(spark: SparkSession, schema: StructType, folder: str, pages: int) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(schema).options(path=folder, pages=str(pages)).load()


def stream_pages(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").schema(schema).options(path=folder).load()
