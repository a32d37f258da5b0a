"""A data source of Parquet footers: what files hold, without reading their rows.

`spark.read.format("parquet_footers").option("files", json)` has a row for each file, row group and column: type, rows, nulls,
least and greatest value.  Each file is a partition; tables and columns are chosen by options, before a footer is opened.
(Filters are not taken over from plans: Spark 4.1 keeps what a Python source has pushed for all later queries of the same DataFrame.)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, table string, row_group int, column string, position int, type string, rows long, nulls long, least string, greatest string, bytes long"


class _File(InputPartition):
    def __init__(self, path: str, table: str) -> None:
        super().__init__(path)
        self.path, self.table = path, table


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, str]], columns: set[str] | None) -> None:
        self.files, self.columns = files, columns

    def partitions(self) -> list[_File]:
        return [_File(*x) for x in self.files] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if not partition.path:
            return
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as source:
            footer = pq.ParquetFile(source).metadata
            for group in range(footer.num_row_groups):
                part = footer.row_group(group)
                for position in range(part.num_columns):
                    column = part.column(position)
                    name = column.path_in_schema
                    if self.columns is not None and name not in self.columns:
                        continue
                    facts = column.statistics if column.is_stats_set else None
                    known = facts is not None and facts.has_min_max
                    nulls = facts.null_count if facts is not None and facts.has_null_count else None
                    text = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
                    yield (partition.path, partition.table, group, name, position, footer.schema.column(position).physical_type, column.num_values, nulls, text(facts.min) if known else None, text(facts.max) if known else None, column.total_compressed_size)


class ParquetFooters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        columns = json.loads(self.options.get("columns", "null"))
        return _Reader([tuple(x) for x in json.loads(self.options["files"])], None if columns is None else set(columns))


def footers(spark: SparkSession, tables: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """The footers of all files of tables (name: path of a file or folder), for all columns or some."""
    spark.dataSource.register(ParquetFooters)
    files = [(f, name) for name, path in tables.items() for f in spark.read.parquet(path).inputFiles()]
    return spark.read.format("parquet_footers").options(files=json.dumps(files), columns=json.dumps(columns)).load()


def summary(rows: DataFrame, kind: str = "long") -> DataFrame:
    """table, column, type, rows, nulls, least, greatest of columns of one kind; null counts are null where a file does not have them."""
    known = F.count("nulls") == F.count("*")
    return rows.groupBy("table", "column").agg(
        F.first("type").alias("type"), F.sum("rows").alias("rows"), F.when(known, F.sum("nulls")).alias("nulls"), F.min(F.col("least").cast(kind)).alias("least"), F.max(F.col("greatest").cast(kind)).alias("greatest"))


def key_check(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, keys, nulls, is_key of what is declared as a key: equal keys meet, and a key with most rows is counted before."""
    n = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    found = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(~bad, 1)).alias("keys"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("nulls"))
    return found.withColumn("is_key", (F.col("rows") == F.col("keys")) & (F.col("nulls") == 0))


def reference_check(rows: DataFrame, column: str, others: DataFrame, key: str) -> DataFrame:
    """rows and missing: how many refer to a key that is not there."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    known = others.select(F.col(key).alias("k"), F.lit(True).alias("hit")).distinct()
    return counts.join(known, "k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
