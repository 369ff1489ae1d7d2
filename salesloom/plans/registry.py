"""Every registered query by name: a callable of the session and the folder with the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.operators.dedup import classes, duplicate_edges, expand, find_duplicates, people
from salesloom.operators.quality import detect_issues, matching_view
from salesloom.operators.scoring import score_leads
from salesloom.plans import dashboard
from salesloom.plans.jobs import JOBS
from salesloom.plans.questions import METRICS, QUESTIONS, Plan
from salesloom.plans.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]

DASHBOARD: dict[str, Plan] = {
    "overview_totals": dashboard.overview_totals,
    "overview_issues": dashboard.issues_by_type,
    "overview_stages": dashboard.stages,
    "overview_histogram": dashboard.score_histogram,
    "overview_top_leads": dashboard.top_open_leads,
    "lead_list_whole": dashboard.lead_view,
    "lead_list_search": lambda t: dashboard.list_leads(
        t, sort="name", order="asc", page_size=20, q="smi", stage=["new,contacted", "won"])[0],
    "lead_list_page_2": lambda t: dashboard.list_leads(t, sort="last_contacted_at", page=2, issue="any")[0],
    "lead_list_total": lambda t: dashboard.list_leads(t, industry="Software", issue="none")[1],
    "call_sheet": lambda t: dashboard.call_sheet(t)[0],
    "issue_list": lambda t: dashboard.list_issues(t)[0],
    "issue_list_duplicates_page_2": lambda t: dashboard.list_issues(t, "duplicate", page=2, page_size=20)[0],
    "latest_activities": dashboard.latest_activities,
    "issues_either_side": dashboard.issues_per_lead,
    "find_duplicates": lambda t: find_duplicates(matching_view(t.leads, t.companies)),
    "duplicate_classes": lambda t: classes(people(matching_view(t.leads, t.companies))).select(
        "block", "first", "last", "kind", "value", "members", F.col("oldest.lead_id").alias("oldest"), F.col("newest.lead_id").alias("newest")),
    "duplicate_edges": lambda t: duplicate_edges(matching_view(t.leads, t.companies)),
    "expanded_duplicates": lambda t: expand(matching_view(t.leads, t.companies), t.leads.filter("owner = 'Karl Lindt'")),
    "detect_issues": lambda t: detect_issues(t.leads, t.companies, t.as_of),
    "score_leads": lambda t: score_leads(t.leads, t.companies, t.activities, t.as_of),
}


def on_workspace(plan: Plan) -> Query:
    return lambda spark, sf_dir: plan(Workspace(spark, sf_dir))


QUERIES: dict[str, Query] = {name: on_workspace(plan) for name, plan in {**QUESTIONS, **METRICS, **DASHBOARD, **JOBS}.items()}
