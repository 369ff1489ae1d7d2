"""Changes of tables by key sets, and checks of their constraints."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """`new` replaces the rows of `old` with the same key."""
    return old.join(new, key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_keys(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(keys, key, "left_anti").select(*df.columns)


def update_keys(df: DataFrame, keys: DataFrame, key: str, changes: Mapping[str, Column]) -> DataFrame:
    """Set columns on the rows whose key is in `keys`; other rows stay as they are."""
    marked = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
                           for c in df.columns])


def violations(df: DataFrame, primary_key: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """One row per broken constraint with the number of rows that break it."""
    required = list(dict.fromkeys([*primary_key, *not_null]))
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    as_rows = F.array(*[F.struct(F.lit(f"{c} is null").alias("violation"), F.col(c).alias("rows")) for c in required])
    null_rows = nulls.select(F.explode(as_rows).alias("v")).select("v.*")
    repeated = (df.groupBy(*primary_key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                .agg(F.lit(f"{', '.join(primary_key)} not unique").alias("violation"), F.count(F.lit(1)).alias("rows")))
    return null_rows.unionByName(repeated).filter(F.col("rows") > 0)


def require_constraints(df: DataFrame, primary_key: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """The same frame, or an error naming the broken constraints, to call before publishing a table."""
    broken = violations(df, primary_key, not_null).collect()  # at most one row per constraint
    if broken:
        raise ValueError("; ".join(f"{r['violation']} in {r['rows']} rows" for r in broken))
    return df


def with_default_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """Additive schema change: the column with a default where an older table lacks it."""
    return df if name in df.columns else df.withColumn(name, default)
