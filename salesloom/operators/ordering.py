"""Dense numbering, top-k and paging without pulling a table into one task.

`store_order` keeps a table in the order of its pages: range-partitioned, sorted, and numbered in its own columns, in files of one
range each. Beside it lie its fences, a row for each file: the numbers of its first and last row. A page reads the files whose
fences it meets, and in them the row groups with its numbers; nothing is sorted or counted again, however deep the page lies.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.sources.storage import reliable

NUMBER = "_number"

# A page that ends within this many rows is one bounded top-k; deeper pages use the dense numbering. Both give the same rows.
TOP_K_ROWS = 10_000


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_number", start: int | Column = 1) -> DataFrame:
    """Add dense numbers `start, start+1, ...` in a total order.

    Rows are range-partitioned and sorted, the sorted rows are fixed by a reliable checkpoint, and
    every partition starts at the count of the partitions before it. Only one row per partition is
    ever gathered, so no window runs over the whole table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = reliable(ranged)
    tagged = fixed.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        tagged.join(F.broadcast(offsets), "_part")  # one row per partition of the sort
        .withColumn(name, (F.col("_mono") - F.col("_first") + F.col("_offset") + base).cast("bigint"))
        .drop("_part", "_mono", "_first", "_offset")
    )


def id_text(prefix: str, number: Column) -> Column:
    """IDs such as LD-00042; numbers above five digits keep all their digits."""
    return F.format_string(f"{prefix}-%05d", number)


def highest_number(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row with the highest number used in the IDs of `key`, 0 for an empty table."""
    number = F.substring(F.col(key), F.lit(len(prefix) + 2), F.length(key)).cast("bigint")
    return df.agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))


def with_ids(df: DataFrame, order: Sequence[Column | str], key: str, prefix: str, existing: DataFrame | None = None) -> DataFrame:
    """Give every row the next free ID in the given order, continuing after the IDs in `existing`."""
    numbered = number_rows(df, order, "_n")
    if existing is None:
        return numbered.withColumn(key, id_text(prefix, F.col("_n"))).drop("_n")
    last = highest_number(existing, key, prefix)  # exactly one row
    return (numbered.crossJoin(F.broadcast(last))
            .withColumn(key, id_text(prefix, F.col("_n") + F.col("highest"))).drop("_n", "highest"))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "position") -> DataFrame:
    """At most `k` rows per group. Spark keeps k rows per group before the shuffle, so a hot group stays small."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page_of(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """Page `page` (from 1) of the ordered rows."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    first = (page - 1) * page_size
    if first + page_size <= TOP_K_ROWS:
        return df.orderBy(*order).offset(first).limit(page_size)
    numbered = number_rows(df, order, "_n")
    return numbered.filter((F.col("_n") > first) & (F.col("_n") <= first + page_size)).orderBy("_n").drop("_n")


def store_order(df: DataFrame, order: Sequence[Column | str], path: str, rows_per_file: int = 1_000_000) -> str:
    """Write the rows in a total order below `path`, numbered from 1, and their fences."""
    numbered = number_rows(df, order, NUMBER)
    part = F.floor((F.col(NUMBER) - 1) / rows_per_file)
    # One task for each file of `rows_per_file` rows; the numbers lie dense in it, so its row groups have narrow ranges.
    files = numbered.withColumn("_file", part).repartitionByRange("_file").sortWithinPartitions("_file", NUMBER)
    files.write.partitionBy("_file").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    files.limit(0).write.parquet(f"{path}/columns")  # a table without rows has no files
    stored = df.sparkSession.read.schema(files.schema).parquet(f"{path}/rows")
    fences = stored.groupBy("_file").agg(F.min(NUMBER).alias("first"), F.max(NUMBER).alias("last"))
    fences.repartitionByRange("first").sortWithinPartitions("first").write.parquet(f"{path}/fences")
    return path


def stored_page(spark: SparkSession, path: str, page: int, page_size: int) -> tuple[DataFrame, int]:
    """Page `page` (from 1) of a stored order, and the number of all rows."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    first = (page - 1) * page_size
    fences = spark.read.parquet(f"{path}/fences")
    wanted = [r["_file"] for r in fences.filter((F.col("last") > first) & (F.col("first") <= first + page_size)).select("_file").collect()]  # as many as a page has files
    total = fences.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows").filter(F.col("_file").isin(wanted) & (F.col(NUMBER) > first) & (F.col(NUMBER) <= first + page_size))
    return rows.orderBy(NUMBER).drop("_file", NUMBER), total
