"""Numbers without gaps over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.shared import shared_folder


def numbered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows with a number from 1 without gaps in the given order, which should tell them apart.

    They are range-partitioned and written once, so that ranges stay what they are; ranges are counted (a row each), and a
    row's number is its place within its range after all ranges before. No task sees more than its range."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "numbered")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"__range": F.spark_partition_id(), "__at": at})
    ranged.write.parquet(folder)
    kept = spark.read.schema(ranged.schema).parquet(folder)
    sizes = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).orderBy("__range").collect()  # a row a range
    before, total = [], 0
    for r in sizes:
        before.append((r["__range"], total))
        total += r["__n"]
    base = spark.createDataFrame(before, "__range int, __base long")
    return kept.join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__at") + 1).drop("__range", "__at", "__base")
