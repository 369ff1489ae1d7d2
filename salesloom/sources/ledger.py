"""The append-only ledger of calls, kept as JSON lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = ("at string, provider string, model string, purpose string, ok boolean, prompt_tokens bigint, "
                 "completion_tokens bigint, total_tokens bigint, rate_limit_retries bigint, latency_ms bigint, error string")


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Entries, or only those at or after an ISO date or time prefix."""
    entries = spark.read.schema(LEDGER_SCHEMA).json(path)
    return entries if since is None else entries.filter(F.col("at") >= since)


def _purpose() -> Column:
    return F.when(F.coalesce("purpose", F.lit("")) != "", F.col("purpose")).otherwise("other").alias("purpose")


def ledger_totals(entries: DataFrame) -> DataFrame:
    tokens = F.sum(F.when(F.col("ok"), F.coalesce("total_tokens", F.lit(0))))
    return entries.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("ok")).alias("ok"),
                       F.count_if(~F.col("ok")).alias("failed"), F.coalesce(tokens, F.lit(0)).alias("tokens"))


def ledger_by_purpose(entries: DataFrame) -> DataFrame:
    """Tokens, calls and whole tokens per call of the successful calls, most tokens first."""
    grouped = (entries.filter(F.col("ok")).select(_purpose(), F.coalesce("total_tokens", F.lit(0)).alias("t"))
               .groupBy("purpose").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("calls")))
    per_call = F.floor(F.col("tokens") / F.greatest(F.col("calls"), F.lit(1))).alias("tokens_per_call")
    return grouped.select("purpose", "tokens", "calls", per_call).orderBy(F.desc("tokens"), "purpose")


def ledger_errors(entries: DataFrame, k: int = 5) -> DataFrame:
    return (entries.filter(~F.col("ok")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "error").limit(k))
