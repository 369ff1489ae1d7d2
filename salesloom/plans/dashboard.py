"""Dashboard totals, lead and issue lists, lead detail and row look-ups."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.config import ALL_STAGES, CALL_SHEET_MIN_SCORE, CLOSED_STAGES, OPEN_STAGES
from salesloom.functions.numbers import exact_avg, exact_sum
from salesloom.operators.ordering import page_of, top_k_per_group
from salesloom.plans.metrics import Tables

SORT_KEYS = ("score", "fit", "intent", "recency", "name", "company", "stage", "owner", "last_contacted_at",
             "deal_value", "created_at", "lead_id")
ROW_TABLES = {"LD": ("leads", "lead_id"), "CO": ("companies", "company_id"),
              "ACT": ("activities", "activity_id"), "ISS": ("data_issues", "issue_id")}


def is_open() -> Column:
    return ~F.col("stage").isin(*CLOSED_STAGES)


def overview_totals(tables: Tables, actions: DataFrame | None = None) -> DataFrame:
    """One row of totals: one aggregation per table, joined as one-row frames."""
    open_deal = F.when(is_open(), F.col("deal_value"))
    frames = [
        tables.leads.agg(F.count(F.lit(1)).alias("leads"), F.count_if(is_open()).alias("open_leads"),
                         F.round(exact_sum(open_deal), 0).cast("double").alias("open_pipeline")),
        tables.companies.agg(F.count(F.lit(1)).alias("companies")),
        tables.activities.agg(F.count(F.lit(1)).alias("activities")),
        tables.lead_scores.agg(F.round(exact_avg(F.col("score")), 1).alias("avg_score")),
        tables.data_issues.agg(F.count_distinct("lead_id").alias("leads_with_issues")),
    ]
    if actions is not None:
        frames.append(actions.agg(F.count_if(F.col("status") == "pending").alias("pending_actions")))
    row = reduce(DataFrame.crossJoin, frames)  # every frame has exactly one row
    share = F.lit(100) * (F.lit(1) - F.col("leads_with_issues") / F.nullif(F.col("leads"), F.lit(0)))
    return row.withColumn("clean_pct", F.coalesce(F.round(share, 1), F.lit(0.0)))


def health_counts(tables: Tables, stored_results: DataFrame) -> DataFrame:
    """Leads and stored results, and whether there is any data."""
    leads = tables.leads.agg(F.count(F.lit(1)).alias("leads"))
    entries = stored_results.agg(F.count(F.lit(1)).alias("entries"))
    return leads.crossJoin(entries).withColumn("ready", F.col("leads") > 0)  # two one-row frames


def issues_by_type(tables: Tables) -> DataFrame:
    return tables.data_issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


def stage_order() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ALL_STAGES]), F.col("stage"))


def stages(tables: Tables) -> DataFrame:
    """Count, share of all leads and average score per stage, in business order."""
    counted = (tables.leads.select("lead_id", "stage").join(tables.lead_scores.select("lead_id", "score"), "lead_id")
               .groupBy("stage").agg(F.count(F.lit(1)).alias("count"), F.round(exact_avg(F.col("score")), 1).alias("avg_score")))
    total = tables.leads.agg(F.count(F.lit(1)).alias("total"))
    return (counted.crossJoin(F.broadcast(total))  # one row
            .select("stage", "count", "avg_score", (F.col("count") / F.col("total")).alias("share")).orderBy(stage_order()))


def score_histogram(tables: Tables) -> DataFrame:
    """Leads per score band of ten points; empty bands are filled, the median band is marked."""
    band = (F.least(F.floor(F.col("score") / 10), F.lit(9)) * 10).cast("int")
    counts = tables.lead_scores.groupBy(band.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    bands = tables.lead_scores.sparkSession.range(10).select((F.col("id") * 10).cast("int").alias("bucket"))
    filled = bands.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ten rows
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = filled.select("bucket", "count", F.sum("count").over(upto).alias("cum"), F.sum("count").over(whole).alias("total"))
    reached = F.when(F.col("cum") >= F.col("total") / 2, F.col("bucket"))
    return running.select("bucket", "count", (F.col("bucket") == F.min(reached).over(whole)).alias("is_median"))


def top_open_leads(tables: Tables, k: int = 8) -> DataFrame:
    firms = tables.companies.select("company_id", F.col("name").alias("company"))
    name = F.concat("first_name", F.lit(" "), "last_name").alias("name")
    return (tables.leads.filter(is_open()).join(tables.lead_scores, "lead_id").join(firms, "company_id")
            .select("lead_id", name, "company", "stage", "owner", "score", "fit", "intent", "recency")
            .orderBy(F.desc("score"), F.asc("lead_id")).limit(k))


def lead_view(tables: Tables) -> DataFrame:
    """All leads with company, score and the sorted distinct issue types ([] if none)."""
    firms = tables.companies.select("company_id", F.col("name").alias("company"), "industry", "employees", "country",
                                    F.col("company_id").alias("_firm"))
    kinds = tables.data_issues.groupBy("lead_id").agg(F.array_sort(F.collect_set("issue_type")).alias("_kinds"))
    lead_columns = ["lead_id", "first_name", "last_name", "email", "phone", "title", "seniority", "stage", "owner", "source",
                    "deal_value", "created_at", "last_contacted_at", "updated_at"]
    return (
        tables.leads.join(firms, "company_id", "left").join(tables.lead_scores, "lead_id", "left")
        .join(kinds, "lead_id", "left")
        .select(*lead_columns, F.col("_firm").alias("company_id"), "company", "industry", "employees", "country",
                "score", "fit", "intent", "recency",
                F.coalesce("_kinds", F.array().cast("array<string>")).alias("issues"))
    )


def filter_leads(tables: Tables, q: str | None = None, stage: list[str] | None = None, owner: str | None = None,
                 industry: str | None = None, issue: str | None = None, min_score: float | None = None) -> DataFrame:
    """Leads for which all given filters hold. `%` and `_` in `q` act as wildcards."""
    df = lead_view(tables)
    tests: list[Column] = []
    if q:
        pattern = f"%{q.strip()}%"
        name = F.concat("first_name", F.lit(" "), "last_name")
        tests.append(F.col("lead_id").ilike(pattern) | name.ilike(pattern) | F.col("email").ilike(pattern)
                     | F.col("company").ilike(pattern))
    if stage:
        tests.append(F.col("stage").isin([s for part in stage for s in part.split(",") if s]))
    if owner:
        tests.append(F.col("owner") == owner)
    if industry:
        tests.append(F.col("industry") == industry)
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    if issue == "any":
        tests.append(F.size("issues") > 0)
    elif issue == "none":
        tests.append(F.size("issues") == 0)
    elif issue:
        tests.append(F.array_contains("issues", issue))
    return df.filter(reduce(Column.__and__, tests, F.lit(True)))


def sort_columns(sort: str, order: str) -> list[Column]:
    if sort not in SORT_KEYS or order not in ("asc", "desc"):
        raise ValueError(f"sort must be one of {sorted(SORT_KEYS)}, order asc or desc")
    key = {"name": F.lower(F.concat("last_name", F.lit(" "), "first_name")), "company": F.lower("company")}.get(sort, F.col(sort))
    return [key.asc_nulls_last() if order == "asc" else key.desc_nulls_last(), F.asc("lead_id")]


def list_leads(tables: Tables, sort: str = "score", order: str = "desc", page: int = 1, page_size: int = 50,
               **filters) -> tuple[DataFrame, DataFrame]:
    """The asked page and a one-row frame with the total."""
    matched = filter_leads(tables, **filters)
    return (page_of(matched, sort_columns(sort, order), page, page_size),
            matched.agg(F.count(F.lit(1)).alias("total")))


def call_sheet(tables: Tables, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """Open leads with a score of 80 or more, best first."""
    return list_leads(tables, page=page, page_size=page_size, stage=list(OPEN_STAGES), min_score=CALL_SHEET_MIN_SCORE)


def issue_order() -> list[Column]:
    return [F.asc("issue_type"), F.col("score").desc_nulls_last(), F.asc("issue_id")]


def issue_rows(tables: Tables, issue_type: str | None = None) -> DataFrame:
    issues = tables.data_issues
    if issue_type:
        issues = issues.filter(F.col("issue_type") == issue_type)
    firms = tables.companies.select("company_id", F.col("name").alias("company"))
    name = F.concat("first_name", F.lit(" "), "last_name").alias("name")
    people = tables.leads.select("lead_id", "company_id", name, "owner", "stage")
    return (issues.join(people, "lead_id").join(firms, "company_id", "left")
            .join(tables.lead_scores.select("lead_id", "score"), "lead_id", "left")
            .select("issue_id", "issue_type", "details", "lead_id", "related_lead_id", "name", "company", "owner", "stage", "score"))


def list_issues(tables: Tables, issue_type: str | None = None, page: int = 1, page_size: int = 100) -> tuple[DataFrame, DataFrame]:
    issues = tables.data_issues if issue_type is None else tables.data_issues.filter(F.col("issue_type") == issue_type)
    return page_of(issue_rows(tables, issue_type), issue_order(), page, page_size), issues.agg(F.count(F.lit(1)).alias("total"))


def latest_activities(tables: Tables, k: int = 50) -> DataFrame:
    """The newest activities of every lead."""
    return top_k_per_group(tables.activities, ["lead_id"], [F.desc("occurred_at"), F.asc("activity_id")], k)


def issues_on_either_side(tables: Tables, lead_id: str) -> DataFrame:
    side = (F.col("lead_id") == lead_id) | (F.col("related_lead_id") == lead_id)
    return (tables.data_issues.filter(side).select("issue_id", "issue_type", "details", "related_lead_id").orderBy("issue_id"))


def issues_per_lead(tables: Tables) -> DataFrame:
    """Batch form of the either-side match: (lead, issue) with the lead as subject or as original."""
    own = tables.data_issues.select("lead_id", "issue_id", F.lit("subject").alias("side"))
    other = tables.data_issues.filter(F.col("related_lead_id").isNotNull()).select(
        F.col("related_lead_id").alias("lead_id"), "issue_id", F.lit("related").alias("side"))
    return own.unionByName(other)


def row_by_id(tables: Tables, row_id: str) -> DataFrame:
    """The source row of one cited ID; the prefix names the table."""
    prefix = row_id.split("-", 1)[0]
    if prefix not in ROW_TABLES:
        raise ValueError(f"unknown ID prefix: {prefix}")
    table, key = ROW_TABLES[prefix]
    return getattr(tables, table).filter(F.col(key) == row_id)


def resolve_ids(tables: Tables, ids: DataFrame) -> DataFrame:
    """Source rows of a whole column of cited IDs: `id, table, row` with the row as JSON."""
    parts = []
    for prefix, (table, key) in ROW_TABLES.items():
        wanted = ids.select("id").filter(F.col("id").startswith(f"{prefix}-")).distinct()
        rows = getattr(tables, table)
        as_json = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
        parts.append(rows.select(F.col(key).alias("id"), F.lit(table).alias("table"), as_json.alias("row"))
                     .join(wanted, "id", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def lead_detail(tables: Tables, lead_id: str) -> dict[str, DataFrame]:
    """The frames of one lead's page; every one filters on the key before anything is joined."""
    from salesloom.operators.scoring import breakdowns, citations

    one = tables.leads.filter(F.col("lead_id") == lead_id)
    acts = tables.activities.filter(F.col("lead_id") == lead_id)
    breakdown = breakdowns(one, tables.companies, acts, tables.as_of)
    return {
        "lead": lead_view(tables).filter(F.col("lead_id") == lead_id),
        "breakdown": breakdown,
        "citations": citations(breakdown),
        "activities": acts.select("activity_id", "type", "occurred_at").orderBy(F.desc("occurred_at"), F.asc("activity_id")).limit(50),
        "issues": issues_on_either_side(tables, lead_id),
    }
