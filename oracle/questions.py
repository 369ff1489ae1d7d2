"""SQL of the reference questions, metrics and dashboard reports."""

from oracle.base import one_decimal
from salesloom.plans.fixture import AS_OF_TEXT

OPEN = "stage NOT IN ('won', 'lost')"
SCORED = "leads l JOIN lead_scores s ON s.lead_id = l.lead_id JOIN companies c ON c.company_id = l.company_id"
LS = "leads l JOIN lead_scores s ON s.lead_id = l.lead_id"
IL = "data_issues i JOIN leads l ON l.lead_id = i.lead_id"
ALC = "activities a JOIN leads l ON l.lead_id = a.lead_id JOIN companies c ON c.company_id = l.company_id"


def since(days: int, column: str = "occurred_at") -> str:
    return f"{column} >= {AS_OF_TEXT} - INTERVAL '{days}' DAY"


def avg(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,4))) AS DOUBLE) / count({column})"


def total(column: str) -> str:
    return f"CAST(round(sum(CAST({column} AS DECIMAL(18,4))), 0) AS DOUBLE)"


def leads(where: str) -> str:
    return f"SELECT count(*) AS n FROM leads WHERE {where}"


def top(source: str, where: str, k: int, by: str = "s.score") -> str:
    return f"SELECT l.lead_id FROM {source} WHERE {where} ORDER BY {by} DESC, l.lead_id LIMIT {k}"


QUESTIONS = {
    "q01_total_leads": leads("TRUE"),
    "q02_open_leads": leads(OPEN),
    "q03_stale_leads": "SELECT count(DISTINCT lead_id) AS n FROM data_issues WHERE issue_type = 'stale'",
    "q04_duplicate_leads": "SELECT count(DISTINCT lead_id) AS n FROM data_issues WHERE issue_type = 'duplicate'",
    "q05_missing_email": leads("email IS NULL OR trim(email) = ''"),
    "q06_missing_phone": leads("phone IS NULL OR trim(phone) = ''"),
    "q07_missing_title": leads("title IS NULL OR trim(title) = ''"),
    "q08_negotiation": leads("stage = 'negotiation'"),
    "q09_owner_leads": leads("owner = 'Ines Vogt'"),
    "q10_fintech_companies": "SELECT count(*) AS n FROM companies WHERE industry = 'Fintech'",
    "q11_demo_last_7_days": f"SELECT count(DISTINCT lead_id) AS n FROM activities WHERE type = 'demo_request' AND {since(7)}",
    "q12_pricing_last_30_days": f"SELECT count(DISTINCT lead_id) AS n FROM activities WHERE type = 'pricing_page_visit' AND {since(30)}",
    "q13_never_contacted": leads("last_contacted_at IS NULL"),
    "q14_score_above_80": "SELECT count(*) AS n FROM lead_scores WHERE score > 80",
    "q15_average_score": f"SELECT round({avg('score')}, 1) AS n FROM lead_scores",
    "q16_open_deal_value": f"SELECT {total('deal_value')} AS n FROM leads WHERE {OPEN}",
    "q17_recent_activities": f"SELECT count(*) AS n FROM activities WHERE {since(30)}",
    "q18_won": leads("stage = 'won'"),
    "q19_from_referrals": leads("source = 'referral'"),
    "q20_c_level": leads("seniority = 'c_level'"),
    "q21_highest_score": "SELECT max(score) AS n FROM lead_scores",
    "q22_stale_of_owner": f"SELECT count(DISTINCT i.lead_id) AS n FROM {IL} WHERE i.issue_type = 'stale' AND l.owner = 'Karl Lindt'",
    "q23_large_companies": "SELECT count(*) AS n FROM companies WHERE employees > 1000",
    "q24_leads_in_germany": "SELECT count(*) AS n FROM leads l JOIN companies c ON c.company_id = l.company_id WHERE c.country = 'DE'",
    "q25_average_won_deal": f"SELECT round({avg('deal_value')}, 0) AS n FROM leads WHERE stage = 'won'",
    "q26_top_10": top(LS, "TRUE", 10),
    "q27_top_open_fintech": top(SCORED, f"c.industry = 'Fintech' AND l.{OPEN}", 5),
    "q28_top_of_owner": top(SCORED, "l.owner = 'Lena Hoek'", 5),
    "q29_fintech_demo_3_days": f"SELECT DISTINCT a.lead_id FROM {ALC} WHERE c.industry = 'Fintech' AND a.type = 'demo_request' AND {since(3, 'a.occurred_at')}",
    "q30_top_stale": "SELECT i.lead_id FROM data_issues i JOIN lead_scores s ON s.lead_id = i.lead_id WHERE i.issue_type = 'stale' ORDER BY s.score DESC, i.lead_id LIMIT 10",
    "q31_ids_missing_email": "SELECT lead_id FROM leads WHERE email IS NULL OR trim(email) = ''",
    "q32_top_proposal": top(SCORED, "l.stage = 'proposal'", 5),
    "q33_top_c_level_software": top(SCORED, "l.seniority = 'c_level' AND c.industry = 'Software'", 5),
    "q34_negotiation_at_large": "SELECT l.lead_id FROM leads l JOIN companies c ON c.company_id = l.company_id WHERE c.employees > 5000 AND l.stage = 'negotiation'",
    "q35_top_uk": top(SCORED, "c.country = 'GB'", 5),
    "q36_duplicates_of_owner": f"SELECT DISTINCT i.lead_id FROM {IL} WHERE i.issue_type = 'duplicate' AND l.owner = 'Ines Vogt'",
    "q37_top_from_events": top(SCORED, "l.source = 'event'", 5),
    "q38_open_large_deals": f"SELECT lead_id FROM leads WHERE {OPEN} AND deal_value > 60000",
    "q39_top_never_contacted": top(LS, "l.last_contacted_at IS NULL", 5),
    "q40_healthcare_meeting_2_days": f"SELECT DISTINCT a.lead_id FROM {ALC} WHERE c.industry = 'Healthcare' AND a.type = 'meeting' AND {since(2, 'a.occurred_at')}",
    "q41_leads_by_owner": "SELECT owner, count(*) AS value FROM leads GROUP BY 1",
    "q42_leads_by_stage": "SELECT stage, count(*) AS value FROM leads GROUP BY 1",
    "q43_score_by_industry": f"SELECT c.industry, round({avg('s.score')}, 1) AS value FROM {SCORED} GROUP BY 1",
    "q44_stale_by_owner": f"SELECT l.owner, count(DISTINCT i.lead_id) AS value FROM {IL} WHERE i.issue_type = 'stale' GROUP BY 1",
    "q45_leads_by_source": "SELECT source, count(*) AS value FROM leads GROUP BY 1",
    "q46_demos_by_industry": f"SELECT c.industry, count(*) AS value FROM {ALC} WHERE a.type = 'demo_request' AND {since(30, 'a.occurred_at')} GROUP BY 1",
    "q47_pipeline_by_owner": f"SELECT owner, {total('deal_value')} AS value FROM leads WHERE {OPEN} GROUP BY 1",
    "q48_leads_by_seniority": "SELECT seniority, count(*) AS value FROM leads GROUP BY 1",
    "q49_issues_by_type": "SELECT issue_type, count(*) AS value FROM data_issues GROUP BY 1",
    "q50_score_by_country": f"SELECT c.country, round({avg('s.score')}, 1) AS value FROM {SCORED} GROUP BY 1",
    "h01_negotiating": leads("stage = 'negotiation'"),
    "h02_closed_successfully": leads("stage = 'won'"),
    "h03_no_phone": leads("phone IS NULL OR trim(phone) = ''"),
    "h04_not_reached": leads("last_contacted_at IS NULL"),
    "h05_mean_c_level_score": f"SELECT round({avg('s.score')}, 1) AS n FROM {LS} WHERE l.seniority = 'c_level'",
    "h06_open_healthcare_of_owner": f"SELECT count(*) AS n FROM {SCORED} WHERE l.{OPEN} AND c.industry = 'Healthcare' AND l.owner = 'Otto Brandt'",
    "h07_vp_us_qualified": f"SELECT l.lead_id FROM {SCORED} WHERE l.seniority = 'vp' AND c.industry = 'Logistics' AND c.country = 'US' AND l.stage = 'qualified'",
    "h08_director_linkedin_score": f"SELECT count(*) AS n FROM {SCORED} WHERE l.seniority = 'director' AND l.source = 'linkedin' AND s.score > 60",
    "h09_canadian_c_level_70": f"SELECT l.lead_id FROM {SCORED} WHERE c.country = 'CA' AND l.seniority = 'c_level' AND s.score >= 70",
    "h10_created_in_june": leads("created_at >= TIMESTAMP '2023-06-01' AND created_at < TIMESTAMP '2023-07-01'"),
    "h11_pricing_in_month": "SELECT count(*) AS n FROM activities WHERE type = 'pricing_page_visit' AND occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-02-01'",
    "h12_media_demo_first_week": f"SELECT DISTINCT a.lead_id FROM {ALC} WHERE c.industry = 'Media' AND a.type = 'demo_request' AND a.occurred_at >= TIMESTAMP '2024-01-01' AND a.occurred_at < TIMESTAMP '2024-01-08'",
    "h13_contacted_before": leads(f"{OPEN} AND last_contacted_at < TIMESTAMP '2023-12-01'"),
    "h14_new_duplicates": f"SELECT count(DISTINCT i.lead_id) AS n FROM {IL} WHERE i.issue_type = 'duplicate' AND {since(30, 'l.created_at')}",
    "h15_top_deals_manufacturing": top(SCORED, "c.industry = 'Manufacturing' AND l.deal_value IS NOT NULL", 5, "l.deal_value"),
    "h16_largest_german_companies": "SELECT company_id FROM companies WHERE country = 'DE' ORDER BY employees DESC NULLS LAST, company_id LIMIT 3",
    "h17_top_industries_by_deal": f"SELECT c.industry, round({avg('l.deal_value')}, 0) AS value FROM {SCORED} WHERE l.{OPEN} GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 4",
    "h18_won_by_owner": "SELECT owner, count(*) AS value FROM leads WHERE stage = 'won' GROUP BY 1",
    "h19_outside_software": "SELECT count(*) AS n FROM leads l JOIN companies c ON c.company_id = l.company_id WHERE c.industry NOT IN ('Software', 'Fintech')",
    "h20_open_without_activity": f"SELECT count(*) AS n FROM leads l WHERE l.{OPEN} AND NOT EXISTS (SELECT 1 FROM activities a WHERE a.lead_id = l.lead_id)",
    "h21_clean_education": "SELECT l.lead_id FROM leads l JOIN companies c ON c.company_id = l.company_id WHERE c.industry = 'Education' AND l.stage = 'negotiation' AND NOT EXISTS (SELECT 1 FROM data_issues i WHERE i.lead_id = l.lead_id)",
    "h22_fresh_but_quiet": f"SELECT count(*) AS n FROM leads l WHERE l.last_contacted_at < {AS_OF_TEXT} - INTERVAL '60' DAY AND NOT EXISTS (SELECT 1 FROM data_issues i WHERE i.lead_id = l.lead_id AND i.issue_type = 'stale')",
    "h23_stale_by_stage": f"SELECT l.stage, count(DISTINCT i.lead_id) AS value FROM {IL} WHERE i.issue_type = 'stale' GROUP BY 1",
    "d07_demo_never_contacted": "SELECT DISTINCT l.lead_id FROM leads l JOIN activities a ON a.lead_id = l.lead_id WHERE a.type = 'demo_request' AND l.last_contacted_at IS NULL",
    "d08_replies_of_owner": "SELECT count(*) AS n FROM activities a JOIN leads l ON l.lead_id = a.lead_id WHERE l.owner = 'Lena Hoek' AND a.type = 'email_reply' AND a.occurred_at >= TIMESTAMP '2024-01-01' AND a.occurred_at < TIMESTAMP '2024-02-01'",
    "d09_won_deal_by_industry": f"SELECT c.industry, {avg('l.deal_value')} AS value FROM leads l JOIN companies c ON c.company_id = l.company_id WHERE l.stage = 'won' GROUP BY 1",
    "d10_call_first": top(LS, f"l.{OPEN}", 5),
}

LISTED = "SELECT l.lead_id, l.first_name || ' ' || l.last_name AS name, c.name AS company, l.stage, l.owner, s.score"
ISSUE = "EXISTS (SELECT 1 FROM data_issues i WHERE i.lead_id = l.lead_id{})"
METRICS = {
    "metric_count_open_fintech": f"SELECT count(*) AS lead_count FROM {SCORED} WHERE l.{OPEN} AND c.industry = 'Fintech'",
    "metric_list_top_open": f"{LISTED} FROM {SCORED} WHERE l.{OPEN} ORDER BY s.score DESC, l.lead_id LIMIT 25",
    "metric_list_capped": f"{LISTED} FROM {SCORED} WHERE l.source IN ('website', 'referral') ORDER BY s.score DESC, l.lead_id LIMIT 200",
    "metric_list_all": f"{LISTED} FROM {SCORED} WHERE l.source IN ('website', 'referral') ORDER BY s.score DESC, l.lead_id",
    "metric_list_500": f"{LISTED} FROM {SCORED} ORDER BY s.score DESC, l.lead_id LIMIT 500",
    "metric_avg_score_by_seniority": f"SELECT l.seniority, round({avg('s.score')}, 1) AS avg_score FROM {SCORED} GROUP BY 1",
    "metric_max_score_by_source": f"SELECT l.source, max(s.score) AS max_score FROM {SCORED} WHERE c.employees > 50 GROUP BY 1",
    "metric_sum_deal_by_country": f"SELECT c.country, {total('l.deal_value')} AS total_deal_value FROM {SCORED} WHERE l.stage NOT IN ('lost') GROUP BY 1",
    "metric_avg_deal_never_contacted": f"SELECT round({avg('l.deal_value')}, 0) AS avg_deal_value FROM {SCORED} WHERE l.last_contacted_at IS NULL",
    "metric_stale_by_industry": f"SELECT c.industry, count(*) AS lead_count FROM {SCORED} WHERE " + ISSUE.format(" AND i.issue_type = 'stale'") + " GROUP BY 1",
    "metric_missing_phone_by_owner": f"SELECT l.owner, count(*) AS lead_count FROM {SCORED} WHERE " + ISSUE.format(" AND i.details = 'Missing phone'") + " GROUP BY 1",
    "metric_active_leads": f"SELECT count(*) AS lead_count FROM {SCORED} WHERE s.score >= 40 AND EXISTS (SELECT 1 FROM activities a WHERE a.lead_id = l.lead_id AND a.type = 'call' AND {since(5, 'a.occurred_at')})",
    "metric_clean_leads": f"SELECT count(*) AS lead_count FROM {SCORED} WHERE NOT " + ISSUE.format(""),
    "metric_flagged_not_stale": f"SELECT count(*) AS lead_count FROM {SCORED} WHERE " + ISSUE.format("") + " AND NOT " + ISSUE.format(" AND i.issue_type = 'stale'"),
    "metric_quiet_leads": f"SELECT count(*) AS lead_count FROM {SCORED} WHERE NOT EXISTS (SELECT 1 FROM activities a WHERE a.lead_id = l.lead_id)",
    "metric_companies_in_size": "SELECT count(*) AS company_count FROM companies WHERE employees > 100 AND country = 'US'",
    "metric_activities_by_type": f"SELECT a.type, count(*) AS activity_count FROM {ALC} JOIN lead_scores s ON s.lead_id = l.lead_id WHERE l.stage = 'new' AND {since(10, 'a.occurred_at')} GROUP BY 1",
    "metric_activities_by_stage": f"SELECT l.stage, count(*) AS activity_count FROM {ALC} JOIN lead_scores s ON s.lead_id = l.lead_id WHERE a.type = 'meeting' AND {since(20, 'a.occurred_at')} GROUP BY 1",
    "metric_calls_of_five_days": f"SELECT count(*) AS activity_count FROM {ALC} JOIN lead_scores s ON s.lead_id = l.lead_id WHERE a.type = 'call' AND {since(5, 'a.occurred_at')} AND {since(30, 'a.occurred_at')}",
    "metric_activity_count": f"SELECT count(*) AS activity_count FROM {ALC} JOIN lead_scores s ON s.lead_id = l.lead_id WHERE {since(30, 'a.occurred_at')}",
    "metric_issues_by_type": "SELECT issue_type, count(*) AS issue_count FROM data_issues GROUP BY 1",
    "metric_issue_count": "SELECT count(*) AS issue_count FROM data_issues",
}

LEAD_VIEW = """
SELECT l.lead_id, l.first_name, l.last_name, l.email, l.phone, l.title, l.seniority, l.stage, l.owner, l.source, l.deal_value,
       l.created_at, l.last_contacted_at, l.updated_at, c.company_id, c.name AS company, c.industry, c.employees, c.country,
       s.score, s.fit, s.intent, s.recency,
       coalesce((SELECT list(DISTINCT i.issue_type ORDER BY i.issue_type) FROM data_issues i WHERE i.lead_id = l.lead_id), []) AS issues
FROM leads l LEFT JOIN companies c ON c.company_id = l.company_id LEFT JOIN lead_scores s ON s.lead_id = l.lead_id"""
ISSUE_LIST = """
SELECT i.issue_id, i.issue_type, i.details, i.lead_id, i.related_lead_id, l.first_name || ' ' || l.last_name AS name,
       c.name AS company, l.owner, l.stage, s.score
FROM data_issues i JOIN leads l ON l.lead_id = i.lead_id LEFT JOIN companies c ON c.company_id = l.company_id
LEFT JOIN lead_scores s ON s.lead_id = l.lead_id"""
DASHBOARD = {
    "overview_totals": f"""
SELECT *, round(100 * (1 - leads_with_issues / leads), 1) AS clean_pct FROM (
SELECT (SELECT count(*) FROM leads) AS leads, (SELECT count(*) FROM leads WHERE {OPEN}) AS open_leads,
       (SELECT {total('deal_value')} FROM leads WHERE {OPEN}) AS open_pipeline,
       (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM activities) AS activities,
       (SELECT round({avg('score')}, 1) FROM lead_scores) AS avg_score,
       (SELECT count(DISTINCT lead_id) FROM data_issues) AS leads_with_issues)""",
    "overview_issues": "SELECT issue_type, count(*) AS count FROM data_issues GROUP BY 1",
    "overview_stages": f"SELECT l.stage, count(*) AS count, round({avg('s.score')}, 1) AS avg_score, count(*) / (SELECT count(*) FROM leads) AS share FROM {LS} GROUP BY 1",
    "overview_histogram": """
SELECT bucket, count, coalesce(bucket = min(CASE WHEN cum >= total / 2 THEN bucket END) OVER (), FALSE) AS is_median FROM (
SELECT bucket, count, sum(count) OVER (ORDER BY bucket) AS cum, sum(count) OVER () AS total FROM (
SELECT CAST(b.range * 10 AS INT) AS bucket, count(s.score) AS count FROM range(10) b
LEFT JOIN lead_scores s ON least(floor(s.score / 10), 9) = b.range GROUP BY 1))""",
    "overview_top_leads": f"SELECT l.lead_id, l.first_name || ' ' || l.last_name AS name, c.name AS company, l.stage, l.owner, s.score, s.fit, s.intent, s.recency FROM {SCORED} WHERE l.{OPEN} ORDER BY s.score DESC, l.lead_id LIMIT 8",
    "lead_list_whole": LEAD_VIEW,
    "lead_list_search": LEAD_VIEW + " WHERE (l.lead_id ILIKE '%smi%' OR (l.first_name || ' ' || l.last_name) ILIKE '%smi%' OR l.email ILIKE '%smi%' OR c.name ILIKE '%smi%') AND l.stage IN ('new', 'contacted', 'won') ORDER BY lower(l.last_name || ' ' || l.first_name) ASC NULLS LAST, l.lead_id LIMIT 20",
    "lead_list_page_2": LEAD_VIEW + " WHERE EXISTS (SELECT 1 FROM data_issues i WHERE i.lead_id = l.lead_id) ORDER BY l.last_contacted_at DESC NULLS LAST, l.lead_id LIMIT 50 OFFSET 50",
    "lead_list_total": "SELECT count(*) AS total FROM leads l LEFT JOIN companies c ON c.company_id = l.company_id WHERE c.industry = 'Software' AND NOT EXISTS (SELECT 1 FROM data_issues i WHERE i.lead_id = l.lead_id)",
    "call_sheet": LEAD_VIEW + " WHERE l.stage IN ('new', 'contacted', 'qualified', 'proposal', 'negotiation') AND s.score >= 80 ORDER BY s.score DESC NULLS LAST, l.lead_id LIMIT 50",
    "issue_list": ISSUE_LIST + " ORDER BY i.issue_type, s.score DESC NULLS LAST, i.issue_id LIMIT 100",
    "issue_list_duplicates_page_2": ISSUE_LIST + " WHERE i.issue_type = 'duplicate' ORDER BY i.issue_type, s.score DESC NULLS LAST, i.issue_id LIMIT 20 OFFSET 20",
    "latest_activities": "SELECT activity_id, lead_id, type, occurred_at, position FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY occurred_at DESC, activity_id) AS position FROM activities) WHERE position <= 50",
    "issues_either_side": "SELECT lead_id, issue_id, 'subject' AS side FROM data_issues UNION ALL SELECT related_lead_id, issue_id, 'related' FROM data_issues WHERE related_lead_id IS NOT NULL",
    "find_duplicates": "SELECT lead_id, related_lead_id, reason FROM duplicate_pairs",
    "duplicate_classes": """
SELECT block, first, last, kind, value, count(*) AS members, arg_min(lead_id, {'t': created_at, 'id': lead_id}) AS oldest, arg_max(lead_id, {'t': created_at, 'id': lead_id}) AS newest
FROM (SELECT *, 'name' AS kind, '' AS value FROM mailed UNION ALL SELECT *, 'phone', phone FROM mailed WHERE phone IS NOT NULL
      UNION ALL SELECT *, 'mail', mail_key FROM mailed WHERE email IS NOT NULL UNION ALL SELECT *, 'bare', '' FROM mailed WHERE email IS NULL)
WHERE first <> '' AND last <> '' GROUP BY block, first, last, kind, value""",
    "duplicate_edges": "\nUNION ALL ".join(f"""
SELECT why, block, first_old, last_old, '{old}' AS kind_old, {values[0]} AS value_old, {old.replace('mail', 'key')}_old AS members_old,
       first_new, last_new, '{new}' AS kind_new, {values[1]} AS value_new, {new.replace('mail', 'key')}_new AS members_new, related_lead_id, lead_id
FROM rated WHERE {rule}""" for old, new, values, rule in (
        ("phone", "phone", ("phone", "phone"), "why <> 'same name' AND rep_phone"),
        ("bare", "name", ("''", "''"), "why <> 'same name' AND rep_bare_old"),
        ("name", "bare", ("''", "''"), "why <> 'same name' AND rep_bare_new"),
        ("mail", "mail", ("key_a", "key_b"), "rep_key AND (why <> 'same name' OR key_a <> key_b) AND why IS NOT NULL AND (key_a = key_b OR ratio >= 85)"))),
    "expanded_duplicates": "SELECT lead_id, related_lead_id, reason FROM full_pairs WHERE lead_id IN (SELECT lead_id FROM leads WHERE owner = 'Karl Lindt') OR related_lead_id IN (SELECT lead_id FROM leads WHERE owner = 'Karl Lindt')",
    "detect_issues": "SELECT issue_id, lead_id, issue_type, details, related_lead_id FROM data_issues",
    "score_leads": "SELECT lead_id, score, fit, intent, recency FROM lead_scores",
}
