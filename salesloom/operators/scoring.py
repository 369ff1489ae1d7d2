"""Lead scores 0..100: fit + intent + recency, with every point attributed to a source row.

The stored scores need only mergeable sums, so they are computed by one map-side combined
aggregation. Attributions come as a long table with one row per point; per-lead structs hold at most
`PROMPT_CONTRIBUTIONS` rows per component, so a lead with very many activities stays small.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.config import (
    CLOSED_STAGES, FIT_MAX, INDUSTRY_DEFAULT_POINTS, INDUSTRY_POINTS, INTENT_HALF_LIFE_DAYS, INTENT_MAX,
    INTENT_WEIGHTS, INTENT_WINDOW_DAYS, PROMPT_CONTRIBUTIONS, RECENCY_MAX, SENIORITY_LABELS, SENIORITY_POINTS,
    SIZE_BANDS,
)
from salesloom.functions.clock import elapsed_days, instant, minute_text
from salesloom.functions.lookup import ladder
from salesloom.functions.numbers import one_decimal, whole_text
from salesloom.functions.text import plural
from salesloom.operators.ordering import top_k_per_group

SCORE_COLUMNS = ["lead_id", "score", "fit", "intent", "recency"]
COMPONENTS = ("fit", "intent", "recency")


# ------------------------------------------------------------------ component expressions

def _or_unknown(text: Column) -> Column:
    return F.when(text.isNotNull() & (text != ""), text).otherwise("unknown")


def seniority_points(seniority: Column) -> Column:
    return ladder(SENIORITY_POINTS, _or_unknown(seniority), 0)


def size_points(employees: Column) -> Column:
    out = None
    for floor, points in SIZE_BANDS:
        hit = F.coalesce(employees, F.lit(0)) >= floor
        out = F.when(hit, F.lit(float(points))) if out is None else out.when(hit, F.lit(float(points)))
    return out.otherwise(F.lit(0.0))


def industry_points(industry: Column) -> Column:
    return ladder(INDUSTRY_POINTS, _or_unknown(industry), INDUSTRY_DEFAULT_POINTS)


def activity_points(kind: Column, age_days: Column) -> Column:
    """Weight of the activity halved every ten days, in points with two decimals."""
    decay = F.pow(F.lit(0.5), age_days / F.lit(INTENT_HALF_LIFE_DAYS))
    return F.bround(ladder(INTENT_WEIGHTS, kind, 0.0) * decay, 2)


def recent(age_days: Column) -> Column:
    return age_days.between(0, INTENT_WINDOW_DAYS)


def recency_points(days: Column, stage: Column) -> Column:
    return (
        F.when(F.coalesce(stage.isin(*CLOSED_STAGES), F.lit(False)), F.lit(0.0))
        .when(days.isNull(), F.lit(12.0))
        .when(days <= 2, F.lit(2.0))
        .when(days <= 7, one_decimal(F.lit(2.0) + (days - 2) * 2))
        .when(days <= 30, F.lit(RECENCY_MAX))
        .otherwise(one_decimal(F.lit(RECENCY_MAX) * F.pow(F.lit(0.5), (days - 30) / 30)))
    )


def recency_text(days: Column, stage: Column) -> Column:
    touched = F.concat(F.lit("contacted "), whole_text(days), F.lit("d ago, "))
    return (
        F.when(F.coalesce(stage.isin(*CLOSED_STAGES), F.lit(False)),
               F.concat(F.lit("closed ("), stage, F.lit("), no follow-up due")))
        .when(days.isNull(), "never contacted, first touch due")
        .when(days <= 2, F.concat(touched, F.lit("just touched")))
        .when(days <= 7, F.concat(touched, F.lit("follow-up coming due")))
        .when(days <= 30, F.concat(touched, F.lit("follow-up overdue")))
        .otherwise(F.concat(touched, F.lit("going cold")))
    )


def fit_text(seniority: Column, has_company: Column, employees: Column, industry: Column) -> Column:
    level = _or_unknown(seniority)
    label = level
    for code, words in SENIORITY_LABELS.items():
        label = F.when(level == code, words).otherwise(label)
    size = F.when(F.coalesce(employees, F.lit(0)) != 0, F.concat(employees.cast("string"), F.lit("-person"))
                  ).otherwise("unknown-size")
    trade = F.when(F.coalesce(industry, F.lit("")) != "", industry).otherwise("unclassified")
    return F.when(has_company, F.concat(label, F.lit(" at a "), size, F.lit(" "), trade, F.lit(" company"))
                  ).otherwise(F.concat(label, F.lit(", company unknown")))


# ------------------------------------------------------------------ relations

def recent_activities(activities: DataFrame, as_of: datetime) -> DataFrame:
    """Activities of the intent window with age and points; the range bounds reach the scan."""
    now = instant(as_of)
    age = elapsed_days(now, F.col("occurred_at"))
    start = now - F.make_dt_interval(F.lit(INTENT_WINDOW_DAYS))
    return (
        activities.filter(F.col("occurred_at").between(start, now))
        .select("activity_id", "lead_id", "type", age.alias("age"))
        .filter(recent(F.col("age")))
        .withColumn("points", activity_points(F.col("type"), F.col("age")))
    )


def intent_totals(activities: DataFrame, as_of: datetime) -> DataFrame:
    """Points per lead summed in whole hundredths, so the total does not depend on row order."""
    cents = F.round(F.col("points") * 100).cast("bigint")
    return (recent_activities(activities, as_of).groupBy("lead_id")
            .agg(F.sum(cents).alias("_cents")))


def _lead_inputs(leads: DataFrame, companies: DataFrame, as_of: datetime) -> DataFrame:
    firms = companies.select("company_id", F.lit(True).alias("_has_company"),
                             F.col("employees").alias("_employees"), F.col("industry").alias("_industry"))
    days = F.when(F.col("last_contacted_at").isNotNull(), elapsed_days(instant(as_of), F.col("last_contacted_at")))
    return (
        leads.select("lead_id", "company_id", "seniority", "stage", "last_contacted_at")
        .join(firms, "company_id", "left")
        .withColumn("_has_company", F.coalesce("_has_company", F.lit(False)))
        .withColumn("_days", days)
        .withColumn("_stage", F.coalesce("stage", F.lit("")))
    )


def _component_points() -> dict[str, Column]:
    company_part = F.when(F.col("_has_company"), size_points(F.col("_employees")) + industry_points(F.col("_industry")))
    raw = F.coalesce(F.col("_cents"), F.lit(0)) / F.lit(100.0)
    return {
        "fit": seniority_points(F.col("seniority")) + F.coalesce(company_part, F.lit(0.0)),
        "intent": one_decimal(F.least(F.lit(INTENT_MAX), raw)),
        "recency": recency_points(F.col("_days"), F.col("_stage")),
    }


def score_leads(leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime,
                scope: DataFrame | None = None) -> DataFrame:
    """Scores of all leads, or of the leads in `scope(lead_id)` only."""
    if scope is not None:
        keys = scope.select("lead_id").distinct()
        leads = leads.join(keys, "lead_id", "left_semi")
        activities = activities.join(keys, "lead_id", "left_semi")
    joined = _lead_inputs(leads, companies, as_of).join(intent_totals(activities, as_of), "lead_id", "left")
    parts = joined.select("lead_id", *[c.alias(n) for n, c in _component_points().items()])
    total = F.round(F.col("fit") + F.col("intent") + F.col("recency"), 1)
    return parts.select("lead_id", total.alias("score"), "fit", "intent", "recency")


def rescore(scores: DataFrame, leads: DataFrame, companies: DataFrame, activities: DataFrame, touched: DataFrame,
            as_of: datetime) -> DataFrame:
    """Stored scores with the touched leads recomputed; rows of deleted leads go away."""
    keys = touched.select("lead_id").distinct()
    untouched = scores.join(keys, "lead_id", "left_anti")
    return untouched.unionByName(score_leads(leads, companies, activities, as_of, keys)).select(*SCORE_COLUMNS)


def contributions(leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime) -> DataFrame:
    """One row per contribution: lead_id, component, place, source, ref, field, value, points.

    `place` orders the fit rows; intent rows are ordered by points (highest first), then ref.
    """
    base = _lead_inputs(leads, companies, as_of)

    def entry(component: str, place: int, source: str, ref: Column, field: str, value: Column, points: Column) -> Column:
        return F.struct(F.lit(component).alias("component"), F.lit(place).alias("place"), F.lit(source).alias("source"),
                        ref.alias("ref"), F.lit(field).alias("field"), value.alias("value"), points.alias("points"))

    staff = F.coalesce(F.col("_employees"), F.lit(0))
    contacted = F.when(F.col("_days").isNotNull(), minute_text(F.col("last_contacted_at"))).otherwise("never")
    rows = F.array(
        entry("fit", 1, "lead", F.col("lead_id"), "seniority", _or_unknown(F.col("seniority")),
              seniority_points(F.col("seniority"))),
        F.when(F.col("_has_company"), entry("fit", 2, "company", F.col("company_id"), "employees", staff.cast("string"),
                                            size_points(F.col("_employees")))),
        F.when(F.col("_has_company"), entry("fit", 3, "company", F.col("company_id"), "industry",
                                            _or_unknown(F.col("_industry")), industry_points(F.col("_industry")))),
        entry("recency", 1, "lead", F.col("lead_id"), "last_contacted_at", contacted,
              recency_points(F.col("_days"), F.col("_stage"))),
    )
    fixed = base.select("lead_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("lead_id", "r.*")
    age = F.col("age")
    when = F.when(age < 1, "today").otherwise(F.concat(whole_text(age), F.lit("d ago")))
    acts = recent_activities(activities, as_of).join(leads.select("lead_id"), "lead_id", "left_semi").select(
        "lead_id", F.lit("intent").alias("component"), F.lit(1).alias("place"), F.lit("activity").alias("source"),
        F.col("activity_id").alias("ref"), F.col("type").alias("field"), when.alias("value"), "points")
    return fixed.unionByName(acts)


def contribution_order() -> list[Column]:
    """Fit rows in their fixed places, intent rows from the strongest."""
    return [F.col("place").asc(), F.col("points").desc(), F.col("ref").asc()]


def intent_summaries(activities: DataFrame, as_of: datetime) -> DataFrame:
    """Per lead the three weightiest activity types with counts: `2 demo requests, 1 call in last 30d`."""
    counts = recent_activities(activities, as_of).groupBy("lead_id", "type").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(counts, ["lead_id"], [ladder(INTENT_WEIGHTS, F.col("type"), 0.0).desc(), F.col("type").asc()], 3)
    words = F.concat(F.col("n").cast("string"), F.lit(" "), plural(F.replace(F.col("type"), F.lit("_"), F.lit(" ")), F.col("n")))
    listed = top.groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct("position", words.alias("words")))).alias("parts"))
    text = F.concat(F.array_join(F.col("parts.words"), ", "), F.lit(f" in last {INTENT_WINDOW_DAYS}d"))
    return listed.select("lead_id", text.alias("summary"))


def breakdowns(leads: DataFrame, companies: DataFrame, activities: DataFrame, as_of: datetime) -> DataFrame:
    """Per lead: score and a struct per component with points, maximum, summary and all its contributions, the strongest first.

    A lead's list holds what 30 days gave it; `contributions` is the same as one row each."""
    strength = (-F.col("points")).alias("strength")
    listed = contributions(leads, companies, activities, as_of).groupBy("lead_id", "component").agg(
        F.array_sort(F.collect_list(F.struct("place", strength, "ref", "source", "field", "value", "points"))).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(r["source"].alias("source"), r["ref"].alias("ref"),
                                                    r["field"].alias("field"), r["value"].alias("value"),
                                                    r["points"].alias("points")))
    lists = listed.groupBy("lead_id").agg(*[
        F.first(F.when(F.col("component") == c, plain), ignorenulls=True).alias(f"_{c}") for c in COMPONENTS])
    base = _lead_inputs(leads, companies, as_of).select(
        "lead_id",
        fit_text(F.col("seniority"), F.col("_has_company"), F.col("_employees"), F.col("_industry")).alias("_fit_text"),
        recency_text(F.col("_days"), F.col("_stage")).alias("_recency_text"))
    quiet = F.lit(f"no activity in the last {INTENT_WINDOW_DAYS} days")
    empty = F.array().cast("array<struct<source:string,ref:string,field:string,value:string,points:double>>")

    def component(name: str, maximum: float, summary: Column) -> Column:
        return F.struct(F.col(name).alias("points"), F.lit(maximum).alias("max_points"), summary.alias("summary"),
                        F.coalesce(F.col(f"_{name}"), empty).alias("contributions")).alias(name)

    return (
        score_leads(leads, companies, activities, as_of)
        .join(base, "lead_id").join(lists, "lead_id", "left")
        .join(intent_summaries(activities, as_of), "lead_id", "left")
        .select("lead_id", "score", component("fit", FIT_MAX, F.col("_fit_text")),
                component("intent", INTENT_MAX, F.coalesce(F.col("summary"), quiet)),
                component("recency", RECENCY_MAX, F.col("_recency_text")))
    )


def citations(breakdown: DataFrame) -> DataFrame:
    """Distinct row IDs behind a breakdown, in component order."""
    refs = F.array_distinct(F.concat(*[F.col(f"{c}.contributions.ref") for c in COMPONENTS]))
    return breakdown.select("lead_id", refs.alias("citations"))


def cited_rows(all_contributions: DataFrame) -> DataFrame:
    """Every (lead, source row) behind a score, however many a lead has."""
    return all_contributions.select("lead_id", "ref").distinct()
