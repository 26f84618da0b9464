"""Key-value stores, databases and queues."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class KeyPartition(InputPartition):
    def __init__(self, keys: list):
        super().__init__(keys)
        self.keys = keys


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, fetch: Callable, keys: list, per_partition: int):
        self.schema, self.fetch, self.keys, self.per_partition = schema, fetch, keys, per_partition

    def partitions(self) -> list[KeyPartition]:
        n = self.per_partition
        return [KeyPartition(self.keys[i : i + n]) for i in range(0, len(self.keys), n)]

    def read(self, partition: KeyPartition) -> Iterator[tuple]:
        for key in partition.keys:
            token = None
            while True:
                rows, token = self.fetch(key, token)
                for r in rows:
                    yield tuple(r.get(f) for f in self.schema.names)
                if token is None:
                    break


def paged_source(name: str, shape: T.StructType, fetch: Callable[[object, object], tuple[Iterable[dict], object]], keys: list, per_partition: int = 1) -> type[DataSource]:
    """A batch source over a paginated store: ``fetch(key, token)`` gives (rows, next token or None). Keys are dealt to partitions; each pages lazily."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return shape

        def reader(self, schema: T.StructType) -> PagedReader:
            return PagedReader(shape, fetch, list(keys), per_partition)

    return Source


def read_paged(spark: SparkSession, name: str, schema: T.StructType, fetch: Callable, keys: list, per_partition: int = 1) -> DataFrame:
    spark.dataSource.register(paged_source(name, schema, fetch, keys, per_partition))
    return spark.read.format(name).load()


def live_documents(docs: DataFrame, core_terms: DataFrame | list[str], doc_type: str = "Legislation", status: int = 1) -> DataFrame:
    """Documents of core terms, of a type and status; many terms come as a DataFrame and join."""
    kept = docs.where(F.contains("doc_type", F.lit(doc_type)) & (F.col("status") == status))
    return kept.where(F.col("core_term").isin(core_terms)) if isinstance(core_terms, list) else kept.join(core_terms.select("core_term").distinct(), "core_term", "left_semi")


class Database:
    """Rows of a JDBC database: reads are split by predicates or a numeric column, writes go through Spark."""

    def __init__(self, spark: SparkSession, url: str, **properties: str):
        self.spark, self.url, self.properties = spark, url, properties

    def read(self, table: str, predicates: list[str] | None = None, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
        if predicates:
            return self.spark.read.jdbc(self.url, table, predicates=predicates, properties=self.properties)
        if column and bounds:
            return self.spark.read.jdbc(self.url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=self.properties)
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def save(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.jdbc(self.url, table, mode=mode, properties=self.properties)


def sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A stream into any writer, batch by batch; a batch may come again after a failure, so the writer must overwrite by its number."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
