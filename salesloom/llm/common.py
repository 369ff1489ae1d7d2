"""Helpers the operators share."""

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.sources.storage import reliable, shared_folder, written

__all__ = ["fresh", "reliable", "shared_folder", "ship", "strings", "table", "utf8", "written"]

BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python tasks can import it wherever they run.

    Texts are long, so where the session leaves Spark's default of rows in an Arrow batch, `BATCH_ROWS` is set instead.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_salesloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="salesloom-code-"), "salesloom.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._salesloom_shipped = True


def utf8(column: str | Column) -> Column:
    """A text as bytes, null as empty; Python tasks then never decode a text they only hash."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text, F.lit("")).cast("binary")


def strings(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df is called so (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
