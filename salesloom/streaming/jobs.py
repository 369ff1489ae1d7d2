"""Streaming twins of the event-driven parts: intent events, limiter, refresh of derived tables, ledger totals."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.config import INTENT_WINDOW_DAYS, RATE_WINDOW_SECONDS
from salesloom.functions.clock import instant
from salesloom.operators.limiter import CHUNK_HITS, FLAGGED, MICROS, flagged_hits, micros_of
from salesloom.operators.ordering import top_k_per_group
from salesloom.operators.quality import missing_issues, stale_issues
from salesloom.operators.scoring import SCORE_COLUMNS, score_leads
from salesloom.sources.ledger import LEDGER_SCHEMA

def stream_folder(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", pattern: str | None = None,
                  files_per_batch: int = 1000) -> DataFrame:
    """A folder of files as a stream; `files_per_batch` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all waiting data to Parquet and stop."""
    query = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()


def _event_time(ts: Column) -> Column:
    """Watermarks need a timestamp with zone; the wall-clock value is taken as UTC."""
    return F.timestamp_micros(micros_of(ts))


# ------------------------------------------------------------------ intent events

def intent_events(activities: DataFrame, as_of: datetime, late: str = "2 days") -> DataFrame:
    """Activities of the intent window, each once, in append mode.

    The intent itself is taken from the written events at read time: points are rounded per event and
    decay with the as-of instant, so no running total could be kept.
    """
    now = instant(as_of)
    start = now - F.make_dt_interval(F.lit(INTENT_WINDOW_DAYS))
    return (activities.filter(F.col("occurred_at").between(start, now))
            .withColumn("event_time", _event_time(F.col("occurred_at")))
            .withWatermark("event_time", late).dropDuplicatesWithinWatermark(["activity_id"]).drop("event_time"))


# ------------------------------------------------------------------ limiter

def limiter(root: str, limit: int, window_seconds: int = RATE_WINDOW_SECONDS, chunk_hits: int = CHUNK_HITS) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: the flags of a stream of `hits(key, t, hit_id)`.

    A micro-batch is flagged like any table, so a key with most of a backlog is cut into chunks. The state is a table with up to
    `limit` last passed times of each key, written anew by every batch; keys that have nothing in the window any more are left
    out of it. Hits that come later than passed ones of their key count as if they came with the last of these. A repeated batch
    overwrites its own folders and nothing else.
    """
    window = window_seconds * MICROS

    def flag(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hits = batch.select("key", micros_of(F.col("t")).alias("at"), "hit_id")
        before = None
        if number:
            before = spark.read.schema("key string, at bigint").parquet(f"{root}/passed/batch={number - 1:09d}")
            last = before.groupBy(F.col("key").alias("of")).agg(F.max("at").alias("last"))
            hits = hits.join(last, F.col("key").eqNullSafe(F.col("of")), "left").select("key", F.when(F.col("at").isNotNull(), F.greatest("at", "last")).alias("at"), "hit_id")
        flagged_hits(hits, limit, window_seconds, before, chunk_hits).write.mode("overwrite").parquet(f"{root}/flags/batch={number:09d}")
        passed = spark.read.schema(FLAGGED).parquet(f"{root}/flags/batch={number:09d}").filter("admitted").select("key", "at")
        passed = passed if before is None else passed.unionByName(before)
        now = passed.agg(F.max("at")).first()[0]
        lasting = top_k_per_group(passed.filter(F.col("at") > (now or 0) - window), ["key"], [F.col("at").desc()], limit)
        lasting.select("key", "at").write.mode("overwrite").parquet(f"{root}/passed/batch={number:09d}")

    return flag


def current_flags(spark: SparkSession, root: str) -> DataFrame:
    """Flags of all hits so far."""
    return spark.read.schema(FLAGGED).parquet(f"{root}/flags/batch=*").drop("at")


# ------------------------------------------------------------------ derived tables

def refresher(root: str, leads: DataFrame, companies: DataFrame, as_of: datetime) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: new activities in, changed scores and issues of the touched leads out.

    Every micro-batch writes its own folder, so a repeated batch overwrites itself and nothing else.
    Readers take the newest row per lead (`current_scores`, `current_issues`).
    """
    activity_root, score_root, issue_root = f"{root}/activities", f"{root}/scores", f"{root}/issues"

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{activity_root}/batch={number:09d}")
        touched = spark.read.schema(batch.schema).parquet(f"{activity_root}/batch={number:09d}").select("lead_id").distinct()
        # Only rows that can change a score: of the touched leads, inside the intent window; repeats go after that.
        oldest = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(INTENT_WINDOW_DAYS))
        recent = spark.read.schema(batch.schema).parquet(activity_root).filter(F.col("occurred_at") >= oldest)
        recent = recent.join(touched, "lead_id", "left_semi").dropDuplicates(["activity_id"])
        scored = score_leads(leads, companies, recent, as_of, touched)
        scored.write.mode("overwrite").parquet(f"{score_root}/batch={number:09d}")
        mine = touched.join(leads.select("lead_id"), "lead_id", "left_semi")
        found = stale_issues(leads, as_of, mine).unionByName(missing_issues(leads, mine)).select("lead_id", "issue_type", "details")
        # A touched lead without issues keeps an empty marker, which replaces its older issues.
        mine.join(found, "lead_id", "left").write.mode("overwrite").parquet(f"{issue_root}/batch={number:09d}")

    return refresh


def _newest(df: DataFrame) -> DataFrame:
    last = df.groupBy("lead_id").agg(F.max("batch").alias("batch"))
    return df.join(last, ["lead_id", "batch"], "left_semi")


def current_scores(spark: SparkSession, root: str, base: DataFrame | None = None) -> DataFrame:
    """Stored scores with the newest change per lead on top."""
    changed = _newest(spark.read.parquet(f"{root}/scores")).select(*SCORE_COLUMNS)
    if base is None:
        return changed
    return base.join(changed.select("lead_id"), "lead_id", "left_anti").select(*SCORE_COLUMNS).unionByName(changed)


def current_issues(spark: SparkSession, root: str) -> DataFrame:
    """Newest stale and missing-field issues of the leads touched so far."""
    newest = _newest(spark.read.parquet(f"{root}/issues"))
    return newest.filter(F.col("issue_type").isNotNull()).select("lead_id", "issue_type", "details")


def run_refresh(activities: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (activities.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


# ------------------------------------------------------------------ ledger

def ledger_stream(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    entries = spark.readStream.schema(LEDGER_SCHEMA).json(folder)
    return entries if since is None else entries.filter(F.col("at") >= since)


def ledger_windows(entries: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tokens, calls and failures per time window and purpose, for update or append mode."""
    purpose = F.when(F.coalesce("purpose", F.lit("")) != "", F.col("purpose")).otherwise("other").alias("purpose")
    timed = entries.select(F.try_to_timestamp("at").alias("time"), purpose, "ok", F.coalesce("total_tokens", F.lit(0)).alias("t"))
    return (timed.withWatermark("time", late).groupBy(F.window("time", width), "purpose")
            .agg(F.sum(F.when(F.col("ok"), F.col("t")).otherwise(0)).alias("tokens"), F.count_if("ok").alias("calls"),
                 F.count_if(~F.col("ok")).alias("failed"))
            .select(F.col("window.start").alias("start"), "purpose", "tokens", "calls", "failed"))
