"""Scores and stale records that follow the clock: only leads whose values change are computed when `as_of` moves on.

Every lead has a due time, the earliest instant at which its score or its stale record may differ from now: the next activity that
lies ahead, any moment while activities decay in the intent window or a contact is on a sloping part of the recency curve, the ends
of the flat parts, 90 days after the last touch, and a day more for a record that says how many days. Closed, long forgotten or
never contacted leads without activity are due late or never. Entries lie in folders by day. A step reads the folders between
the old and the new `as_of`, computes those leads from their own activities, and files them again; it appends and never rewrites.
The newest row of a lead is its state (`current`). Edited leads are filed by `refile`.
"""

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.config import CLOSED_STAGES, INTENT_WINDOW_DAYS, OPEN_STAGES, RECENCY_MAX, STALE_DAYS
from salesloom.functions.clock import days_before, elapsed_days, instant
from salesloom.operators.quality import stale_issues
from salesloom.operators.scoring import SCORE_COLUMNS, score_leads
from salesloom.sources.storage import written

STATE_COLUMNS = [*SCORE_COLUMNS, "stale"]
#: Days after a contact from which recency rounds to 0.0 for good: 20 halves every 30 days from the 30th on, to below 0.05.
FADED_DAYS = 30 + math.ceil(30 * math.log2(RECENCY_MAX / 0.05))


def _after(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def due_times(leads: DataFrame, activities: DataFrame, as_of: datetime) -> DataFrame:
    """(lead_id, due_at): later than as_of; null where nothing can change any more."""
    now, soon = instant(as_of), instant(as_of) + F.make_dt_interval(secs=F.lit(0.000001))
    window = activities.filter(F.col("occurred_at") >= days_before(as_of, INTENT_WINDOW_DAYS))
    acts = window.groupBy("lead_id").agg(F.min(F.when(F.col("occurred_at") <= now, soon).otherwise(F.col("occurred_at"))).alias("_act"))
    contact, days = F.col("last_contacted_at"), elapsed_days(now, F.col("last_contacted_at"))
    closed = F.coalesce(F.col("stage").isin(*CLOSED_STAGES), F.lit(False))
    recency = (F.when(closed | contact.isNull() | (days >= FADED_DAYS), None).when(days < 2, _after(contact, 2)).when((days > 7) & (days < 30), _after(contact, 30)).otherwise(soon))
    touch = F.coalesce("last_contacted_at", "created_at")
    since = elapsed_days(now, touch)
    stale = F.when(F.col("stage").isin(*OPEN_STAGES), F.when(since > STALE_DAYS, touch + F.make_dt_interval((F.floor(since) + 1).cast("int"))).otherwise(_after(touch, STALE_DAYS)))
    found = leads.join(acts, "lead_id", "left").select("lead_id", F.least("_act", recency, stale).alias("due_at"))
    return found.withColumn("due_at", F.when(F.col("due_at").isNotNull(), F.greatest("due_at", soon)))


def _state(leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime) -> DataFrame:
    """Scores and, where a lead is stale, the text of its record."""
    stale = stale_issues(leads, as_of).select("lead_id", F.col("details").alias("stale"))
    return score_leads(leads, companies, activities, as_of).join(stale, "lead_id", "left").select(*STATE_COLUMNS)


def _file(leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime, root: str, step: int) -> None:
    _state(leads, companies, activities, as_of).write.mode("overwrite").parquet(f"{root}/state/step={step:09d}")
    due = due_times(leads, activities, as_of).filter(F.col("due_at").isNotNull()).withColumn("day", F.to_date("due_at"))
    due.repartition("day", F.pmod(F.xxhash64("lead_id"), F.lit(16))).write.mode("overwrite").partitionBy("day").parquet(f"{root}/due/step={step:09d}")


def start(leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime, root: str) -> None:
    """State and calendar of all leads below `root`, as step 0."""
    _file(leads, companies, activities, as_of, root, 0)


def due_leads(spark: SparkSession, root: str, before: datetime, as_of: datetime, steps: int) -> DataFrame:
    """(lead_id) of the leads due after `before` and up to as_of; reads the folders of these days."""
    entries = spark.read.option("basePath", f"{root}/due").schema("lead_id string, due_at timestamp_ntz, step int, day date").parquet(*[f"{root}/due/step={s:09d}" for s in range(steps)])
    days = F.col("day").between(F.lit(before.date()), F.lit(as_of.date()))
    return entries.filter(days & (F.col("due_at") > instant(before)) & (F.col("due_at") <= instant(as_of))).select("lead_id").distinct()


def advance(spark: SparkSession, leads: DataFrame, companies: DataFrame, activities: DataFrame, before: datetime, as_of: datetime, root: str, step: int) -> DataFrame:
    """Move on from `before` as step `step`, the steps counted from 1; the leads that were computed."""
    if as_of < before:
        raise ValueError("the clock only moves on")
    return refile(due_leads(spark, root, before, as_of, step), leads, companies, activities, as_of, root, step)


def refile(due: DataFrame, leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime, root: str, step: int) -> DataFrame:
    """Compute the leads in `due(lead_id)` at as_of and file them as step `step`. Earlier entries of theirs may come up again and do no harm."""
    due = written(due, "due")
    oldest = instant(as_of - timedelta(days=INTENT_WINDOW_DAYS))
    theirs = activities.filter(F.col("occurred_at") >= oldest).join(due, "lead_id", "left_semi")
    _file(leads.join(due, "lead_id", "left_semi"), companies, theirs, as_of, root, step)
    return due


def current(spark: SparkSession, root: str, leads: DataFrame) -> DataFrame:
    """The newest state of every lead that exists."""
    rows = spark.read.option("basePath", f"{root}/state").parquet(f"{root}/state")
    last = rows.groupBy("lead_id").agg(F.max("step").alias("step"))
    return rows.join(last, ["lead_id", "step"], "left_semi").join(leads.select("lead_id"), "lead_id", "left_semi").select(*STATE_COLUMNS)
