"""Data issues: duplicates, stale records and missing fields, in full and for touched leads only."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.config import OPEN_STAGES, REQUIRED_FIELDS, STALE_DAYS
from salesloom.functions.clock import days_before, instant, whole_days
from salesloom.functions.text import blank
from salesloom.operators.dedup import find_duplicates
from salesloom.operators.ordering import with_ids

ISSUE_COLUMNS = ["issue_id", "lead_id", "issue_type", "details", "related_lead_id"]


def _scoped(leads: DataFrame, scope: DataFrame | None) -> DataFrame:
    return leads if scope is None else leads.join(scope.select("lead_id"), "lead_id", "left_semi")


def stale_issues(leads: DataFrame, as_of: datetime, scope: DataFrame | None = None) -> DataFrame:
    """Open leads without contact (or creation, if never contacted) for more than 90 days."""
    last_touch = F.coalesce("last_contacted_at", "created_at")
    days = whole_days(instant(as_of), last_touch).cast("string")
    what = F.when(F.col("last_contacted_at").isNotNull(), F.concat(F.lit("last contacted "), days, F.lit(" days ago"))
                  ).otherwise(F.concat(F.lit("never contacted, created "), days, F.lit(" days ago")))
    return (
        _scoped(leads, scope)
        .filter(F.col("stage").isin(*OPEN_STAGES) & (last_touch < days_before(as_of, STALE_DAYS)))
        .select("lead_id", F.lit("stale").alias("issue_type"),
                F.concat(F.lit("Open lead in stage '"), F.col("stage"), F.lit("', "), what).alias("details"),
                F.lit(None).cast("string").alias("related_lead_id"), F.lit(len(REQUIRED_FIELDS)).alias("kind_order"))
    )


def missing_issues(leads: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row per blank required field, from one scan."""
    empty = [F.when(blank(F.col(f)), F.struct(F.lit(i).alias("place"), F.lit(f).alias("field")))
             for i, f in enumerate(REQUIRED_FIELDS)]
    return (
        _scoped(leads, scope)
        .select("lead_id", F.explode(F.filter(F.array(*empty), lambda f: f.isNotNull())).alias("gap"))
        .select("lead_id", F.lit("missing_field").alias("issue_type"),
                F.concat(F.lit("Missing "), F.col("gap.field")).alias("details"),
                F.lit(None).cast("string").alias("related_lead_id"),
                (F.col("gap.place") + len(REQUIRED_FIELDS) + 1).alias("kind_order"))
    )


def duplicate_issues(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "lead_id", F.lit("duplicate").alias("issue_type"),
        F.concat(F.lit("Likely duplicate of "), F.col("related_lead_id"), F.lit(": "), F.col("reason")).alias("details"),
        "related_lead_id", F.lit(0).alias("kind_order"))


ISSUE_ORDER = ["kind_order", "lead_id", "related_lead_id"]


def matching_view(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """The columns the duplicate search needs, with the company name attached."""
    names = companies.select("company_id", F.col("name").alias("company_name"))
    return (leads.select("lead_id", "company_id", "first_name", "last_name", "email", "phone", "created_at")
            .join(names, "company_id", "left"))


def detect_issues(leads: DataFrame, companies: DataFrame, as_of: datetime) -> DataFrame:
    """All issues with dense IDs: duplicates by lead, then stale leads, then missing fields by field."""
    pairs = find_duplicates(matching_view(leads, companies))
    rows = (duplicate_issues(pairs).unionByName(stale_issues(leads, as_of)).unionByName(missing_issues(leads)))
    return with_ids(rows, ISSUE_ORDER, "issue_id", "ISS").select(*ISSUE_COLUMNS)


def refresh_issues(issues: DataFrame, leads: DataFrame, touched: DataFrame, as_of: datetime) -> DataFrame:
    """Issues after edits to the `touched(lead_id)` leads.

    Stale and missing-field issues are recomputed for these leads only; issues that name a deleted
    lead go away. Edits never add duplicates.
    """
    keys = leads.select("lead_id")
    touched = touched.select("lead_id").distinct()
    lasting = issues.filter(F.col("issue_type") == "duplicate").unionByName(
        issues.filter(F.col("issue_type") != "duplicate").join(touched, "lead_id", "left_anti"))
    owned = lasting.join(keys, "lead_id", "left_semi")
    related = keys.withColumnRenamed("lead_id", "related_lead_id")
    kept = owned.filter(F.col("related_lead_id").isNull()).unionByName(
        owned.filter(F.col("related_lead_id").isNotNull()).join(related, "related_lead_id", "left_semi")
        .select(*ISSUE_COLUMNS)).select(*ISSUE_COLUMNS)
    fresh = stale_issues(leads, as_of, touched).unionByName(missing_issues(leads, touched))
    added = with_ids(fresh, ISSUE_ORDER, "issue_id", "ISS", existing=kept).select(*ISSUE_COLUMNS)
    return kept.unionByName(added)


def issue_totals(issues: DataFrame, leads: DataFrame) -> DataFrame:
    """Leads, leads with an issue and the clean share in percent (0 for an empty table)."""
    flagged = issues.agg(F.count_distinct("lead_id").alias("leads_with_issues"))
    total = leads.agg(F.count(F.lit(1)).alias("leads"))
    share = F.round(F.lit(100) * (F.lit(1) - F.col("leads_with_issues") / F.nullif(F.col("leads"), F.lit(0))), 1)
    return total.crossJoin(flagged).withColumn("clean_pct", F.coalesce(share, F.lit(0.0)))  # two one-row frames
