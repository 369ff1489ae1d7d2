"""The reference questions as DataFrame plans over the five CRM tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.clock import days_before, in_range, in_trailing_window
from salesloom.functions.numbers import exact_avg, exact_sum
from salesloom.functions.text import blank
from salesloom.plans.dashboard import is_open
from salesloom.plans.metrics import (
    Tables, above, active, any_issue, at_least, equals, has_issue, inactive, metric, missing, never_contacted, none_of, one_of,
    open_stage, without_issue,
)

Plan = Callable[[Tables], DataFrame]


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def distinct_leads(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("lead_id").alias("n"))


def leads_where(test: Callable[[Tables], Column]) -> Plan:
    return lambda t: count(t.leads.filter(test(t)))


def firms(t: Tables) -> DataFrame:
    return t.companies.select("company_id", "name", "industry", "country", "employees")


def scored(t: Tables) -> DataFrame:
    return t.leads.join(t.lead_scores, "lead_id").join(firms(t), "company_id")


def with_score(t: Tables) -> DataFrame:
    return t.leads.join(t.lead_scores, "lead_id")


def issues_of_leads(t: Tables, kind: str) -> DataFrame:
    return t.data_issues.filter(F.col("issue_type") == kind).select("lead_id").join(t.leads, "lead_id")


def acts_of_leads(t: Tables, kind: str, when: Column) -> DataFrame:
    """Activities of one type with their lead and company; the time filter stays on the scan side."""
    acts = t.activities.filter((F.col("type") == kind) & when).select("lead_id")
    return acts.join(t.leads.select("lead_id", "company_id", "owner"), "lead_id").join(firms(t), "company_id")


def top(df: DataFrame, k: int, by: str = "score") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc("lead_id")).limit(k).select("lead_id")


def by_group(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(key).agg(value.alias("value"))


N = F.count
WINDOW = lambda t, days: in_trailing_window(F.col("occurred_at"), t.as_of, days)

QUESTIONS: dict[str, Plan] = {
    "q01_total_leads": lambda t: count(t.leads),
    "q02_open_leads": leads_where(lambda t: is_open()),
    "q03_stale_leads": lambda t: distinct_leads(t.data_issues.filter(F.col("issue_type") == "stale")),
    "q04_duplicate_leads": lambda t: distinct_leads(t.data_issues.filter(F.col("issue_type") == "duplicate")),
    "q05_missing_email": leads_where(lambda t: blank(F.col("email"))),
    "q06_missing_phone": leads_where(lambda t: blank(F.col("phone"))),
    "q07_missing_title": leads_where(lambda t: blank(F.col("title"))),
    "q08_negotiation": leads_where(lambda t: F.col("stage") == "negotiation"),
    "q09_owner_leads": leads_where(lambda t: F.col("owner") == "Ines Vogt"),
    "q10_fintech_companies": lambda t: count(t.companies.filter(F.col("industry") == "Fintech")),
    "q11_demo_last_7_days": lambda t: distinct_leads(t.activities.filter((F.col("type") == "demo_request") & WINDOW(t, 7))),
    "q12_pricing_last_30_days": lambda t: distinct_leads(
        t.activities.filter((F.col("type") == "pricing_page_visit") & WINDOW(t, 30))),
    "q13_never_contacted": leads_where(lambda t: F.col("last_contacted_at").isNull()),
    "q14_score_above_80": lambda t: count(t.lead_scores.filter(F.col("score") > 80)),
    "q15_average_score": lambda t: t.lead_scores.agg(F.round(exact_avg(F.col("score")), 1).alias("n")),
    "q16_open_deal_value": lambda t: t.leads.filter(is_open()).agg(
        F.round(exact_sum(F.col("deal_value")), 0).cast("double").alias("n")),
    "q17_recent_activities": lambda t: count(t.activities.filter(WINDOW(t, 30))),
    "q18_won": leads_where(lambda t: F.col("stage") == "won"),
    "q19_from_referrals": leads_where(lambda t: F.col("source") == "referral"),
    "q20_c_level": leads_where(lambda t: F.col("seniority") == "c_level"),
    "q21_highest_score": lambda t: t.lead_scores.agg(F.max("score").alias("n")),
    "q22_stale_of_owner": lambda t: distinct_leads(issues_of_leads(t, "stale").filter(F.col("owner") == "Karl Lindt")),
    "q23_large_companies": lambda t: count(t.companies.filter(F.col("employees") > 1000)),
    "q24_leads_in_germany": lambda t: count(t.leads.join(firms(t).filter(F.col("country") == "DE"), "company_id")),
    "q25_average_won_deal": lambda t: t.leads.filter(F.col("stage") == "won").agg(
        F.round(exact_avg(F.col("deal_value")), 0).alias("n")),
    "q26_top_10": lambda t: top(with_score(t), 10),
    "q27_top_open_fintech": lambda t: top(scored(t).filter((F.col("industry") == "Fintech") & is_open()), 5),
    "q28_top_of_owner": lambda t: top(scored(t).filter(F.col("owner") == "Lena Hoek"), 5),
    "q29_fintech_demo_3_days": lambda t: acts_of_leads(t, "demo_request", WINDOW(t, 3)).filter(
        F.col("industry") == "Fintech").select("lead_id").distinct(),
    "q30_top_stale": lambda t: top(t.data_issues.filter(F.col("issue_type") == "stale").select("lead_id").join(
        t.lead_scores, "lead_id"), 10),
    "q31_ids_missing_email": lambda t: t.leads.filter(blank(F.col("email"))).select("lead_id"),
    "q32_top_proposal": lambda t: top(scored(t).filter(F.col("stage") == "proposal"), 5),
    "q33_top_c_level_software": lambda t: top(scored(t).filter(
        (F.col("seniority") == "c_level") & (F.col("industry") == "Software")), 5),
    "q34_negotiation_at_large": lambda t: t.leads.filter(F.col("stage") == "negotiation").join(
        firms(t).filter(F.col("employees") > 5000), "company_id").select("lead_id"),
    "q35_top_uk": lambda t: top(scored(t).filter(F.col("country") == "GB"), 5),
    "q36_duplicates_of_owner": lambda t: issues_of_leads(t, "duplicate").filter(
        F.col("owner") == "Ines Vogt").select("lead_id").distinct(),
    "q37_top_from_events": lambda t: top(scored(t).filter(F.col("source") == "event"), 5),
    "q38_open_large_deals": lambda t: t.leads.filter(is_open() & (F.col("deal_value") > 60000)).select("lead_id"),
    "q39_top_never_contacted": lambda t: top(with_score(t).filter(F.col("last_contacted_at").isNull()), 5),
    "q40_healthcare_meeting_2_days": lambda t: acts_of_leads(t, "meeting", WINDOW(t, 2)).filter(
        F.col("industry") == "Healthcare").select("lead_id").distinct(),
    "q41_leads_by_owner": lambda t: by_group(t.leads, "owner", N(F.lit(1))),
    "q42_leads_by_stage": lambda t: by_group(t.leads, "stage", N(F.lit(1))),
    "q43_score_by_industry": lambda t: by_group(scored(t), "industry", F.round(exact_avg(F.col("score")), 1)),
    "q44_stale_by_owner": lambda t: by_group(issues_of_leads(t, "stale"), "owner", F.count_distinct("lead_id")),
    "q45_leads_by_source": lambda t: by_group(t.leads, "source", N(F.lit(1))),
    "q46_demos_by_industry": lambda t: by_group(acts_of_leads(t, "demo_request", WINDOW(t, 30)), "industry", N(F.lit(1))),
    "q47_pipeline_by_owner": lambda t: by_group(t.leads.filter(is_open()), "owner",
                                                F.round(exact_sum(F.col("deal_value")), 0).cast("double")),
    "q48_leads_by_seniority": lambda t: by_group(t.leads, "seniority", N(F.lit(1))),
    "q49_issues_by_type": lambda t: by_group(t.data_issues, "issue_type", N(F.lit(1))),
    "q50_score_by_country": lambda t: by_group(scored(t), "country", F.round(exact_avg(F.col("score")), 1)),
    "h01_negotiating": leads_where(lambda t: F.col("stage") == "negotiation"),
    "h02_closed_successfully": leads_where(lambda t: F.col("stage") == "won"),
    "h03_no_phone": leads_where(lambda t: blank(F.col("phone"))),
    "h04_not_reached": leads_where(lambda t: F.col("last_contacted_at").isNull()),
    "h05_mean_c_level_score": lambda t: with_score(t).filter(F.col("seniority") == "c_level").agg(
        F.round(exact_avg(F.col("score")), 1).alias("n")),
    "h06_open_healthcare_of_owner": lambda t: count(scored(t).filter(
        is_open() & (F.col("industry") == "Healthcare") & (F.col("owner") == "Otto Brandt"))),
    "h07_vp_us_qualified": lambda t: scored(t).filter(
        (F.col("seniority") == "vp") & (F.col("industry") == "Logistics") & (F.col("country") == "US")
        & (F.col("stage") == "qualified")).select("lead_id"),
    "h08_director_linkedin_score": lambda t: count(scored(t).filter(
        (F.col("seniority") == "director") & (F.col("source") == "linkedin") & (F.col("score") > 60))),
    "h09_canadian_c_level_70": lambda t: scored(t).filter(
        (F.col("country") == "CA") & (F.col("seniority") == "c_level") & (F.col("score") >= 70)).select("lead_id"),
    "h10_created_in_june": leads_where(lambda t: in_range(F.col("created_at"), "2023-06-01", "2023-07-01")),
    "h11_pricing_in_month": lambda t: count(t.activities.filter(
        (F.col("type") == "pricing_page_visit") & in_range(F.col("occurred_at"), "2024-01-01", "2024-02-01"))),
    "h12_media_demo_first_week": lambda t: acts_of_leads(
        t, "demo_request", in_range(F.col("occurred_at"), "2024-01-01", "2024-01-08")).filter(
        F.col("industry") == "Media").select("lead_id").distinct(),
    "h13_contacted_before": leads_where(
        lambda t: is_open() & (F.col("last_contacted_at") < F.lit("2023-12-01").cast("timestamp_ntz"))),
    "h14_new_duplicates": lambda t: distinct_leads(issues_of_leads(t, "duplicate").filter(
        F.col("created_at") >= days_before(t.as_of, 30))),
    "h15_top_deals_manufacturing": lambda t: top(scored(t).filter(
        (F.col("industry") == "Manufacturing") & F.col("deal_value").isNotNull()), 5, "deal_value"),
    "h16_largest_german_companies": lambda t: t.companies.filter(F.col("country") == "DE").orderBy(
        F.col("employees").desc_nulls_last(), F.asc("company_id")).limit(3).select("company_id"),
    "h17_top_industries_by_deal": lambda t: by_group(scored(t).filter(is_open()), "industry", F.round(
        exact_avg(F.col("deal_value")), 0)).orderBy(F.col("value").desc_nulls_last(), F.asc("industry")).limit(4),
    "h18_won_by_owner": lambda t: by_group(t.leads.filter(F.col("stage") == "won"), "owner", N(F.lit(1))),
    "h19_outside_software": lambda t: count(t.leads.join(
        firms(t).filter(~F.col("industry").isin("Software", "Fintech")), "company_id")),
    "h20_open_without_activity": lambda t: count(t.leads.filter(is_open()).join(
        t.activities.select("lead_id"), "lead_id", "left_anti")),
    "h21_clean_education": lambda t: t.leads.filter(F.col("stage") == "negotiation").join(
        firms(t).filter(F.col("industry") == "Education"), "company_id").join(
        t.data_issues.select("lead_id"), "lead_id", "left_anti").select("lead_id"),
    "h22_fresh_but_quiet": lambda t: count(t.leads.filter(F.col("last_contacted_at") < days_before(t.as_of, 60)).join(
        t.data_issues.filter(F.col("issue_type") == "stale").select("lead_id"), "lead_id", "left_anti")),
    "h23_stale_by_stage": lambda t: by_group(issues_of_leads(t, "stale"), "stage", F.count_distinct("lead_id")),
    "d07_demo_never_contacted": lambda t: t.leads.filter(F.col("last_contacted_at").isNull()).join(
        t.activities.filter(F.col("type") == "demo_request").select("lead_id"), "lead_id", "left_semi").select("lead_id"),
    "d08_replies_of_owner": lambda t: count(t.activities.filter(
        (F.col("type") == "email_reply") & in_range(F.col("occurred_at"), "2024-01-01", "2024-02-01")).select("lead_id").join(
        t.leads.filter(F.col("owner") == "Lena Hoek").select("lead_id"), "lead_id")),
    "d09_won_deal_by_industry": lambda t: by_group(t.leads.filter(F.col("stage") == "won").join(firms(t), "company_id"),
                                                   "industry", exact_avg(F.col("deal_value"))),
    "d10_call_first": lambda t: top(with_score(t).filter(is_open()), 5),
}

# The builder, one plan per kind of answer and filter.
METRICS: dict[str, Plan] = {
    "metric_count_open_fintech": lambda t: metric(t, measure="count", where=[open_stage(), equals("industry", "Fintech")]),
    "metric_list_top_open": lambda t: metric(t, ranked=True, limit=25, where=[open_stage()]),
    "metric_list_capped": lambda t: metric(t, where=[one_of("source", "website", "referral")], limit=200),
    "metric_list_all": lambda t: metric(t, where=[one_of("source", "website", "referral")]),
    "metric_list_500": lambda t: metric(t, limit=500),
    "metric_calls_of_five_days": lambda t: metric(t, entity="activities", measure="count", where=[active(), active("call", 5)]),
    "metric_avg_score_by_seniority": lambda t: metric(t, measure="avg_score", group="seniority"),
    "metric_max_score_by_source": lambda t: metric(t, measure="max_score", group="source", where=[above("employees", 50)]),
    "metric_sum_deal_by_country": lambda t: metric(t, measure="sum_deal", group="country", where=[none_of("stage", "lost")]),
    "metric_avg_deal_never_contacted": lambda t: metric(t, measure="avg_deal", where=[never_contacted()]),
    "metric_stale_by_industry": lambda t: metric(t, measure="count", group="industry", where=[has_issue("stale")]),
    "metric_missing_phone_by_owner": lambda t: metric(t, group="owner", where=[missing("phone")]),
    "metric_active_leads": lambda t: metric(t, measure="count", where=[active("call", 5), at_least("score", 40)]),
    "metric_clean_leads": lambda t: metric(t, measure="count", where=[without_issue()]),
    "metric_flagged_not_stale": lambda t: metric(t, measure="count", where=[any_issue(), without_issue("stale")]),
    "metric_quiet_leads": lambda t: metric(t, measure="count", where=[inactive()]),
    "metric_companies_in_size": lambda t: metric(t, "companies", "count", where=[above("employees", 100), equals("country", "US")]),
    "metric_activities_by_type": lambda t: metric(t, "activities", "count", "type", where=[equals("stage", "new"), active(days=10)]),
    "metric_activities_by_stage": lambda t: metric(t, "activities", "count", "stage", where=[active("meeting", 20)]),
    "metric_activity_count": lambda t: metric(t, "activities", "count"),
    "metric_issues_by_type": lambda t: metric(t, "issues", "count", "type"),
    "metric_issue_count": lambda t: metric(t, "issues", "count"),
}
