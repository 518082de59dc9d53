"""Tables from outside: CSV files with a given schema, and databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, paths: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files. The schema is given, so files are read once; a row that doesn't fit it is an error."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(paths)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[object, object] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database's table, read in parallel ranges of a column. The driver's jar comes with the cluster."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()
