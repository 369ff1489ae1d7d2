"""Metric queries: entity, measure, group and filters give a DataFrame.

A combination the tables cannot answer raises `UnsupportedMetric`; no filter is ever dropped silently.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.config import CLOSED_STAGES
from salesloom.functions.clock import in_trailing_window
from salesloom.functions.numbers import exact_avg, exact_sum

ENTITIES = ("leads", "companies", "activities", "issues")
MEASURES = ("list", "count", "avg_score", "max_score", "sum_deal", "avg_deal")
LEAD_GROUPS = ("owner", "industry", "stage", "source", "country", "seniority")
COMPANY_FIELDS = ("industry", "country", "employees")


class UnsupportedMetric(ValueError):
    """The tables, or this builder, cannot answer the requested combination."""


class Tables(Protocol):
    as_of: datetime
    leads: DataFrame
    companies: DataFrame
    activities: DataFrame
    lead_scores: DataFrame
    data_issues: DataFrame


@dataclass(frozen=True)
class Condition:
    """One filter. `kind` is field, issue or activity; `days` only goes with activities."""

    kind: str
    field: str = ""
    op: str = "="
    value: object = None
    days: int | None = None
    negated: bool = False


def equals(field: str, value: object) -> Condition:
    return Condition("field", field, "=", value)


def one_of(field: str, *values: object) -> Condition:
    return Condition("field", field, "in", values)


def none_of(field: str, *values: object) -> Condition:
    return Condition("field", field, "not in", values)


def above(field: str, value: float) -> Condition:
    return Condition("field", field, ">", value)


def at_least(field: str, value: float) -> Condition:
    return Condition("field", field, ">=", value)


def below(field: str, value: object) -> Condition:
    return Condition("field", field, "<", value)


def open_stage() -> Condition:
    return none_of("stage", *CLOSED_STAGES)


def closed_stage() -> Condition:
    return one_of("stage", *CLOSED_STAGES)


def never_contacted() -> Condition:
    return Condition("field", "last_contacted_at", "is null")


def has_issue(issue_type: str) -> Condition:
    return Condition("issue", "issue_type", "=", issue_type)


def missing(field: str) -> Condition:
    return Condition("issue", "details", "=", f"Missing {field}")


def any_issue() -> Condition:
    return Condition("issue")


def without_issue(issue_type: str | None = None) -> Condition:
    return Condition("issue", "issue_type" if issue_type else "", "=", issue_type, negated=True)


def active(kind: str | None = None, days: int | None = None) -> Condition:
    return Condition("activity", "type", "=", kind, days=days)


def inactive() -> Condition:
    return Condition("activity", negated=True)


def _test(c: Condition) -> Column:
    col = F.col(c.field)
    tests = {"=": lambda: col == c.value, ">": lambda: col > c.value, ">=": lambda: col >= c.value, "<": lambda: col < c.value,
             "in": lambda: col.isin(*c.value), "not in": lambda: ~col.isin(*c.value), "is null": col.isNull}
    return tests[c.op]()


def _keep(df: DataFrame, tables: Tables, c: Condition) -> DataFrame:
    if c.kind == "field":
        return df.filter(_test(c))
    if c.kind == "issue":
        keys = tables.data_issues
        if c.field:
            keys = keys.filter(_test(c))
    else:
        keys = activity_rows(tables, c)
    return df.join(keys.select("lead_id"), "lead_id", "left_anti" if c.negated else "left_semi")


def activity_rows(tables: Tables, c: Condition) -> DataFrame:
    rows = tables.activities
    if c.value is not None:
        rows = rows.filter(F.col("type") == c.value)
    if not c.negated:
        rows = rows.filter(in_trailing_window(F.col("occurred_at"), tables.as_of, 30 if c.days is None else c.days))
    return rows


def counted_activities(tables: Tables, conditions: Sequence[Condition]) -> DataFrame:
    """The activity rows that meet every condition: their kind and their window hold for the same row."""
    rows = tables.activities
    for c in conditions or [active()]:
        if c.value is not None:
            rows = rows.filter(F.col("type") == c.value)
        rows = rows.filter(in_trailing_window(F.col("occurred_at"), tables.as_of, 30 if c.days is None else c.days))
    return rows


def scored_leads(tables: Tables) -> DataFrame:
    """Leads with company and score; leads without either are not counted by metrics."""
    firms = tables.companies.select("company_id", F.col("name").alias("company"), "industry", "country", "employees")
    return tables.leads.join(firms, "company_id").join(tables.lead_scores, "lead_id")


def metric(tables: Tables, entity: str = "leads", measure: str = "list", group: str | None = None,
           where: Sequence[Condition] = (), ranked: bool = False, limit: int | None = None) -> DataFrame:
    if entity not in ENTITIES or measure not in MEASURES:
        raise UnsupportedMetric(f"unknown entity or measure: {entity}, {measure}")
    if ranked and (group or measure != "list"):
        raise UnsupportedMetric("ranking is only supported for individual leads by score")
    acts = [c for c in where if c.kind == "activity"]
    if len({c.value for c in acts if c.value}) > 1:
        raise UnsupportedMetric("more than one activity type is not supported")
    if any(c.days is not None and c.kind != "activity" for c in where):
        raise UnsupportedMetric("a day window is only supported for activities")
    if any(c.days is not None and c.days < 1 for c in where):
        raise UnsupportedMetric("a day window has at least one day")
    if limit is not None and limit < 1:
        raise UnsupportedMetric("a limit is at least 1")
    if group and measure == "list":
        measure = "count"

    if entity == "companies":
        if measure != "count" or group or any(c.kind != "field" or c.field not in COMPANY_FIELDS for c in where):
            raise UnsupportedMetric("only company counts by industry, country or size are supported")
        df = tables.companies
        for c in where:
            df = df.filter(_test(c))
        return df.agg(F.count(F.lit(1)).alias("company_count"))

    if entity == "issues":
        if measure != "count" or where or group not in (None, "type"):
            raise UnsupportedMetric("only issue counts (optionally by type) are supported")
        count = F.count(F.lit(1)).alias("issue_count")
        if group is None:
            return tables.data_issues.agg(count)
        return tables.data_issues.groupBy("issue_type").agg(count).orderBy(F.desc("issue_count"))

    df = scored_leads(tables)
    for c in where:
        if not (entity == "activities" and c.kind == "activity"):
            df = _keep(df, tables, c)

    if entity == "activities":
        if measure != "count":
            raise UnsupportedMetric("only activity counts are supported")
        if any(c.negated for c in acts):
            raise UnsupportedMetric("activities cannot be counted where there are none")
        if group not in (None, "type", *LEAD_GROUPS):
            raise UnsupportedMetric(f"grouping activities by {group} is not supported")
        # Count per lead first, so a lead with very many activities is one small row in the join.
        keys = ["lead_id", "type"] if group == "type" else ["lead_id"]
        rows = counted_activities(tables, acts)
        per_lead = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        joined = per_lead.join(df, "lead_id")
        total = F.coalesce(F.sum("n"), F.lit(0)).alias("activity_count")
        if group is None:
            return joined.agg(total)
        return joined.groupBy(group).agg(total).orderBy(F.desc("activity_count"))

    measures = {
        "count": F.count(F.lit(1)).alias("lead_count"),
        "avg_score": F.round(exact_avg(F.col("score")), 1).alias("avg_score"),
        "max_score": F.max("score").alias("max_score"),
        "sum_deal": F.round(exact_sum(F.col("deal_value")), 0).cast("double").alias("total_deal_value"),
        "avg_deal": F.round(exact_avg(F.col("deal_value")), 0).alias("avg_deal_value"),
    }
    if group:
        if group not in LEAD_GROUPS:
            raise UnsupportedMetric(f"grouping leads by {group} is not supported")
        grouped = df.groupBy(group).agg(measures[measure])
        return grouped.orderBy(F.col(grouped.columns[1]).desc_nulls_last())
    if measure != "list":
        return df.agg(measures[measure])
    size = 10 if limit is None and ranked else limit
    name = F.concat("first_name", F.lit(" "), "last_name").alias("name")
    listed = df.select("lead_id", name, "company", "stage", "owner", "score").orderBy(F.desc("score"), F.asc("lead_id"))
    return listed if size is None else listed.limit(size)
