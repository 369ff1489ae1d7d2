"""SQL of the import, change, evidence, evaluation and event jobs."""

import re

from oracle.base import CTES as BASE
from oracle.base import (
    FIT_WORDS, RECENCY_CASE, RECENCY_WORDS, SIZE_CASE, UNKNOWN_INDUSTRY, UNKNOWN_SENIORITY, case, email, in_list,
)
from oracle.questions import DASHBOARD, ISSUE_LIST
from salesloom.config import (
    ACTIVITY_HOOKS, ACTIVITY_LABELS, COUNTRY_CODES, EMAIL_PATTERN, INDUSTRY_CODES, INDUSTRY_POINTS, INTENT_WEIGHTS, SENIORITY_POINTS, SOURCE_CODES,
    STAGE_CODES,
)
from salesloom.plans.fixture import AS_OF_TEXT, INPUT_SQL, plain_sql
from salesloom.sources.tables import QUERYABLE_TABLES, SCHEMAS

LC = "leads l LEFT JOIN companies c ON c.company_id = l.company_id"
SENIORITY = f"CAST({case(UNKNOWN_SENIORITY, SENIORITY_POINTS, '0')} AS DOUBLE)"
INDUSTRY = f"CAST({case(UNKNOWN_INDUSTRY, INDUSTRY_POINTS, '2')} AS DOUBLE)"
WHEN = "CASE WHEN age < 1 THEN 'today' ELSE format('{:.0f}', age) || 'd ago' END"


def code(column: str) -> str:
    return f"regexp_replace(lower(trim({column})), '[^a-z0-9]', '', 'g')"


def amount(column: str) -> str:
    clean = f"regexp_replace({column}, '[,$€ ]', '', 'g')"
    return (f"CASE WHEN regexp_full_match({clean}, '[0-9]+-[0-9]+') THEN (CAST(split_part({clean}, '-', 1) AS DOUBLE) + CAST(split_part({clean}, '-', 2) AS DOUBLE)) / 2 "
            f"ELSE TRY_CAST(rtrim({clean}, '+') AS DOUBLE) END")


def stamp(column: str) -> str:
    shapes = {r"\d{4}-\d{1,2}-\d{1,2}": "%Y-%m-%d", r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}": "%Y-%m-%d %H:%M",
              r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}": "%Y-%m-%d %H:%M:%S", r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z": "%Y-%m-%dT%H:%M:%SZ",
              r"\d{1,2}/\d{1,2}/\d{4}": "%m/%d/%Y", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2} [ap]m": "%m/%d/%Y %I:%M %p"}
    return "CASE " + " ".join(f"WHEN regexp_full_match({column}, '{p}') THEN try_strptime({column}, '{f}')" for p, f in shapes.items()) + " END"


def noted(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda t: t IS NOT NULL)"


CTES = {
    **{name: plain_sql(name) for name in INPUT_SQL},
    "contributions": f"""
SELECT l.lead_id, 'fit' AS component, 1 AS place, 'lead' AS source, l.lead_id AS ref, 'seniority' AS field, {UNKNOWN_SENIORITY} AS value, {SENIORITY} AS points FROM {LC}
UNION ALL SELECT l.lead_id, 'fit', 2, 'company', c.company_id, 'employees', CAST(coalesce(c.employees, 0) AS VARCHAR), CAST({SIZE_CASE} AS DOUBLE) FROM {LC} WHERE c.company_id IS NOT NULL
UNION ALL SELECT l.lead_id, 'fit', 3, 'company', c.company_id, 'industry', {UNKNOWN_INDUSTRY}, {INDUSTRY} FROM {LC} WHERE c.company_id IS NOT NULL
UNION ALL SELECT l.lead_id, 'recency', 1, 'lead', l.lead_id, 'last_contacted_at', coalesce(strftime(l.last_contacted_at, '%Y-%m-%d %H:%M'), 'never'), CAST({RECENCY_CASE} AS DOUBLE) FROM {LC}
UNION ALL SELECT r.lead_id, 'intent', 1, 'activity', r.activity_id, r.type, {WHEN}, r.points FROM recent r JOIN leads l ON l.lead_id = r.lead_id""",
    "type_counts": f"""
SELECT lead_id, string_agg(CAST(n AS VARCHAR) || ' ' || CASE WHEN n = 1 THEN word WHEN word LIKE '%y' THEN left(word, length(word) - 1) || 'ies' ELSE word || 's' END, ', ' ORDER BY place) || ' in last 30d' AS summary
FROM (SELECT lead_id, replace(type, '_', ' ') AS word, count(*) AS n, row_number() OVER (PARTITION BY lead_id ORDER BY ({case('type', INTENT_WEIGHTS, '0.0')}) DESC, type) AS place
      FROM recent GROUP BY lead_id, type) WHERE place <= 3 GROUP BY lead_id""",
    "signals": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY points DESC, activity_id) AS position FROM (
    SELECT *, {WHEN} AS said, row_number() OVER (PARTITION BY lead_id, type ORDER BY points DESC, activity_id) AS one FROM recent) WHERE one = 1)
WHERE position <= 2""",
    "notes": f"""
SELECT lead_id, upper(left(text, 1)) || substr(text, 2) || '.' AS note, concat_ws(',', refs, firm, lead_id) AS refs FROM (
SELECT l.lead_id, s.refs, c.company_id AS firm, concat_ws('; ', s.words, {FIT_WORDS} || coalesce(' [' || c.company_id || ']', ''), {RECENCY_WORDS} || ' [' || l.lead_id || ']') AS text
FROM {LC} LEFT JOIN (
    SELECT lead_id, string_agg(({case('type', ACTIVITY_LABELS, 'type')}) || ' ' || said || ' [' || activity_id || ']', ' and ' ORDER BY position) AS words,
           string_agg(activity_id, ',' ORDER BY position) AS refs FROM signals GROUP BY lead_id) s ON s.lead_id = l.lead_id)""",
    "trimmed": "SELECT row_no, " + ", ".join(f"trim({c}) AS {c}" for c in (
        "first_name", "last_name", "email", "phone", "title", "company", "domain", "industry", "employees", "country", "stage", "source", "owner",
        "deal_value", "created_at", "last_contacted_at")) + " FROM export_rows",
    "judged": f"""
SELECT *, {noted(f"CASE WHEN email <> '' AND NOT regexp_matches(email, '{EMAIL_PATTERN}') THEN 'invalid email ''' || email || '''' END",
                 "CASE WHEN email = '' AND first_name = '' AND last_name = '' THEN 'no name and no email' END",
                 "CASE WHEN company = '' THEN 'no company' END",
                 "CASE WHEN employees <> '' AND staff IS NULL THEN 'employees ''' || employees || ''' is not a number' END",
                 "CASE WHEN deal_value <> '' AND deal IS NULL THEN 'deal value ''' || deal_value || ''' is not a number' END",
                 f"CASE WHEN created_at <> '' AND made IS NULL THEN 'created date ''' || created_at || ''' is not recognized' WHEN made > {AS_OF_TEXT} THEN 'created date ''' || created_at || ''' is after the data as-of date' END",
                 f"CASE WHEN last_contacted_at <> '' AND met IS NULL THEN 'last contacted date ''' || last_contacted_at || ''' is not recognized' WHEN met > {AS_OF_TEXT} THEN 'last contacted date ''' || last_contacted_at || ''' is after the data as-of date' END")} AS reasons,
       {noted("CASE WHEN stage <> '' AND stage_code IS NULL THEN 'unknown stage ''' || stage || ''', imported as ''new''' END",
              "CASE WHEN created_at = '' THEN 'no create date; using the import date' END")} AS warnings
FROM (SELECT *, {amount('employees')} AS staff, {amount('deal_value')} AS deal, {stamp('created_at')} AS made, {stamp('last_contacted_at')} AS met,
             {case(code('stage'), STAGE_CODES)} AS stage_code FROM trimmed)""",
    "records": f"""
SELECT row_no AS row, nullif(first_name, '') AS first_name, nullif(last_name, '') AS last_name, nullif(email, '') AS email, company,
       nullif(trim(regexp_replace(lower(domain), '^(https?://)?(www\\.)?', ''), '/'), '') AS domain, nullif(phone, '') AS phone, nullif(title, '') AS title,
       CASE WHEN regexp_matches(lower(title), '\\b(chief|ceo|cto|cfo|coo|cro|cmo|cio|founder|co-founder|president|owner)\\b') THEN 'c_level'
            WHEN regexp_matches(lower(title), '\\b(vp|svp|evp|vice president)\\b') THEN 'vp' WHEN regexp_matches(lower(title), '\\b(director|head of)\\b') THEN 'director'
            WHEN regexp_matches(lower(title), '\\b(manager|lead|supervisor)\\b') THEN 'manager' ELSE 'individual' END AS seniority,
       {case(code('industry'), INDUSTRY_CODES, "nullif(industry, '')")} AS industry, {case(code('country'), COUNTRY_CODES, "nullif(country, '')")} AS country,
       CASE WHEN owner = '' THEN 'Unassigned' ELSE owner END AS owner,
       coalesce({case(code('source'), SOURCE_CODES, f"nullif({code('source')}, '')")}, 'import') AS source, coalesce(stage_code, 'new') AS stage,
       CAST(trunc(staff) AS INT) AS employees, deal AS deal_value, CASE WHEN created_at = '' THEN {AS_OF_TEXT} ELSE made END AS created_at, met AS last_contacted_at
FROM judged WHERE len(reasons) = 0""",
    "known_domains": "SELECT lower(domain) AS domain, max(company_id) AS id FROM companies WHERE domain <> '' GROUP BY 1",
    "known_names": "SELECT lower(name) AS name, max(company_id) AS id FROM companies GROUP BY 1",
    "domain_openers": "SELECT domain, min(row) AS row, min_by(lower(company), row) AS name FROM records WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM known_domains) GROUP BY 1",
    "name_openers": """
SELECT n.name, n.row FROM (SELECT lower(company) AS name, min(row) AS row FROM records WHERE domain IS NULL GROUP BY 1) n
LEFT JOIN (SELECT name, min(row) AS row FROM domain_openers GROUP BY 1) d ON d.name = n.name
WHERE n.name NOT IN (SELECT name FROM known_names) AND (d.row IS NULL OR d.row > n.row)""",
    "openers": """
SELECT row, name, domain, printf('CO-%05d', (SELECT max(CAST(substr(company_id, 4) AS INT)) FROM companies) + row_number() OVER (ORDER BY row)) AS id FROM (
SELECT row, name, domain FROM domain_openers UNION ALL SELECT row, name, NULL FROM name_openers)""",
    "resolved": """
SELECT r.row, coalesce(k.id, o.id) AS company_id, k.id IS NULL AS company_is_new FROM records r LEFT JOIN known_domains k ON k.domain = r.domain
LEFT JOIN openers o ON o.domain = r.domain WHERE r.domain IS NOT NULL
UNION ALL SELECT r.row, coalesce(o.id, k.id), o.id IS NOT NULL FROM (SELECT row, lower(company) AS name FROM records WHERE domain IS NULL) r
ASOF LEFT JOIN openers o ON o.name = r.name AND r.row >= o.row LEFT JOIN known_names k ON k.name = r.name""",
    "new_companies": f"""
SELECT o.id AS company_id, r.company AS name, r.domain, r.industry, r.employees, r.country, {AS_OF_TEXT} AS created_at FROM openers o JOIN records r ON r.row = o.row""",
    "new_leads": """
SELECT printf('LD-%05d', (SELECT max(CAST(substr(lead_id, 4) AS INT)) FROM leads) + row_number() OVER (ORDER BY r.row)) AS lead_id, s.company_id, first_name, last_name, email,
       phone, title, seniority, source, stage, deal_value, owner, created_at, last_contacted_at, greatest(created_at, coalesce(last_contacted_at, created_at)) AS updated_at
FROM records r JOIN resolved s ON s.row = r.row""",
    "split_proposals": "SELECT *, string_split(lead_list, ',') AS lead_ids, json_extract_string(payload_json, '$.primary_id') AS asked_primary FROM proposals",
    "judged_proposals": """
SELECT *, coalesce(asked_primary, lead_ids[1]) AS primary_id,
       CASE WHEN len(list_distinct(lead_ids)) <> len(lead_ids) THEN 'lead_ids must be unique'
            WHEN type = 'stage_change' AND json_extract_string(payload_json, '$.stage') NOT IN ('new', 'contacted', 'qualified', 'proposal', 'negotiation', 'won', 'lost')
            THEN 'payload.stage must be one of [''new'', ''contacted'', ''qualified'', ''proposal'', ''negotiation'', ''won'', ''lost'']'
            WHEN type = 'merge' AND len(lead_ids) < 2 THEN 'merge needs at least two lead_ids'
            WHEN type = 'merge' AND NOT list_contains(lead_ids, coalesce(asked_primary, lead_ids[1])) THEN 'payload.primary_id must be one of lead_ids'
            WHEN type = 'outreach' AND (trim(json_extract_string(payload_json, '$.subject')) = '' OR trim(json_extract_string(payload_json, '$.body')) = '')
            THEN 'outreach needs payload.subject and payload.body'
            WHEN missing IS NOT NULL THEN 'unknown lead_ids: ' || missing END AS error
FROM split_proposals LEFT JOIN (
    SELECT proposal_id AS absent, string_agg(lead_id, ', ' ORDER BY place) AS missing
    FROM (SELECT proposal_id, unnest(lead_ids) AS lead_id, generate_subscripts(lead_ids, 1) AS place FROM split_proposals)
    WHERE lead_id NOT IN (SELECT lead_id FROM leads) GROUP BY 1) ON absent = proposal_id""",
    "made_actions": """
SELECT printf('AX-%05d', row_number() OVER (ORDER BY proposal_id)) AS action_id, type, lead_list, lead_ids, primary_id, actor, note,
       CASE type WHEN 'stage_change' THEN '{"stage":"' || json_extract_string(payload_json, '$.stage') || '"}' WHEN 'merge' THEN '{"primary_id":"' || primary_id || '"}'
            ELSE '{"subject":"Hi","body":"Checking in.","channel":"email","citations":[]}' END AS payload_json
FROM judged_proposals WHERE error IS NULL""",
    "ranked_decisions": """
SELECT d.*, row_number() OVER (PARTITION BY d.action_id ORDER BY d."at", d.actor, d.verdict, d.note NULLS FIRST) AS turn, first_value(verdict) OVER (PARTITION BY d.action_id ORDER BY d."at", d.actor, d.verdict, d.note NULLS FIRST) AS stands
FROM decisions d JOIN made_actions a ON a.action_id = d.action_id""",
    "decided": """
SELECT a.action_id, a.type, a.lead_ids, a.primary_id, coalesce(d.verdict, 'pending') AS status, d."at" AS decided_at, d.actor AS decided_by, coalesce(d.note, a.note) AS note
FROM made_actions a LEFT JOIN ranked_decisions d ON d.action_id = a.action_id AND d.turn = 1""",
    "turns": "SELECT action_id, decided_at, unnest(lead_ids) AS lead_id FROM decided WHERE status = 'approved'",
    "planned": """
SELECT action_id, type, lead_ids, primary_id, CASE WHEN EXISTS (SELECT 1 FROM turns t JOIN turns u ON u.lead_id = t.lead_id
            WHERE t.action_id = d.action_id AND (u.decided_at, u.action_id) < (t.decided_at, t.action_id)) THEN 'wait' WHEN missing IS NOT NULL THEN 'gone' ELSE 'run' END AS state, missing
FROM decided d LEFT JOIN (SELECT action_id AS absent, string_agg(lead_id, ', ' ORDER BY place) AS missing
    FROM (SELECT action_id, unnest(lead_ids) AS lead_id, generate_subscripts(lead_ids, 1) AS place FROM decided WHERE status = 'approved')
    WHERE lead_id NOT IN (SELECT lead_id FROM present) GROUP BY 1) ON absent = action_id WHERE status = 'approved'""",
    "present": "SELECT * FROM leads WHERE CAST(substr(lead_id, 4) AS BIGINT) % 97 <> 5",
    "donors": "SELECT action_id, primary_id, lead_id FROM (SELECT action_id, primary_id, unnest(lead_ids) AS lead_id FROM planned WHERE state = 'run' AND type = 'merge') WHERE lead_id <> primary_id",
    "touched": "SELECT action_id, type, unnest(lead_ids) AS lead_id FROM planned WHERE state = 'run'",
    "survivors": """
SELECT d.primary_id, min_by(l.email, l.lead_id) FILTER (trim(l.email) <> '') AS email, min_by(l.phone, l.lead_id) FILTER (trim(l.phone) <> '') AS phone,
       min_by(l.title, l.lead_id) FILTER (trim(l.title) <> '') AS title FROM donors d JOIN leads l ON l.lead_id = d.lead_id GROUP BY 1""",
    "leads_after": f"""
SELECT l.lead_id, l.company_id, l.first_name, l.last_name,
       CASE WHEN l.email IS NULL OR trim(l.email) = '' THEN coalesce(s.email, l.email) ELSE l.email END AS email,
       CASE WHEN l.phone IS NULL OR trim(l.phone) = '' THEN coalesce(s.phone, l.phone) ELSE l.phone END AS phone,
       CASE WHEN l.title IS NULL OR trim(l.title) = '' THEN coalesce(s.title, l.title) ELSE l.title END AS title,
       l.seniority, l.source, CASE WHEN t.type = 'stage_change' THEN 'won' WHEN t.type = 'outreach' AND l.stage = 'new' THEN 'contacted' ELSE l.stage END AS stage,
       l.deal_value, l.owner, l.created_at, CASE WHEN t.type = 'outreach' THEN {AS_OF_TEXT} ELSE l.last_contacted_at END AS last_contacted_at,
       CASE WHEN t.lead_id IS NOT NULL THEN {AS_OF_TEXT} ELSE l.updated_at END AS updated_at
FROM present l LEFT JOIN touched t ON t.lead_id = l.lead_id LEFT JOIN survivors s ON s.primary_id = l.lead_id WHERE l.lead_id NOT IN (SELECT lead_id FROM donors)""",
    "queue_order": "SELECT *, row_number() OVER (ORDER BY decided_at, action_id) AS n FROM decided WHERE status = 'approved'",
    "queue_run": """
SELECT 0::BIGINT AS n, NULL::VARCHAR AS action_id, NULL::VARCHAR AS missing, (SELECT coalesce(list(DISTINCT lead_id), []) FROM turns WHERE lead_id NOT IN (SELECT lead_id FROM present)) AS gone
UNION ALL
SELECT n, action_id, CASE WHEN len(lost) > 0 THEN array_to_string(lost, ', ') END,
       CASE WHEN len(lost) = 0 AND type = 'merge' THEN list_concat(gone, list_filter(lead_ids, lambda x: x <> primary_id)) ELSE gone END
FROM (SELECT q.n, q.action_id, q.type, q.lead_ids, q.primary_id, r.gone, list_filter(q.lead_ids, lambda x: list_contains(r.gone, x)) AS lost
      FROM queue_run r JOIN queue_order q ON q.n = r.n + 1)""",
    "queue_done": "SELECT q.n, q.action_id, q.type, q.lead_ids, q.primary_id, json_extract_string(m.payload_json, '$.stage') AS stage FROM queue_order q JOIN queue_run r ON r.action_id = q.action_id JOIN made_actions m ON m.action_id = q.action_id WHERE r.missing IS NULL",
    "queue_given": "SELECT n, primary_id, lead_id FROM (SELECT n, primary_id, unnest(lead_ids) AS lead_id FROM queue_done WHERE type = 'merge') WHERE lead_id <> primary_id",
    "queue_below": """
SELECT lead_id AS top, lead_id AS node, []::STRUCT(n BIGINT, id VARCHAR)[] AS path FROM present
UNION ALL SELECT b.top, g.lead_id, list_append(b.path, {'n': g.n, 'id': g.lead_id}) FROM queue_below b JOIN queue_given g ON g.primary_id = b.node""",
    "queue_values": """
SELECT top, arg_min(email, path) FILTER (trim(email) <> '') AS email, arg_min(phone, path) FILTER (trim(phone) <> '') AS phone, arg_min(title, path) FILTER (trim(title) <> '') AS title
FROM queue_below b JOIN present p ON p.lead_id = b.node GROUP BY top""",
    "queue_named": """
SELECT lead_id, arg_max(stage, n) FILTER (type = 'stage_change') AS stage, max(n) FILTER (type = 'stage_change') AS staged, max(n) FILTER (type = 'outreach') AS sent
FROM (SELECT n, type, stage, unnest(lead_ids) AS lead_id FROM queue_done) GROUP BY lead_id""",
    "queue_after": f"""
SELECT l.* REPLACE (coalesce(v.email, l.email) AS email, coalesce(v.phone, l.phone) AS phone, coalesce(v.title, l.title) AS title,
       CASE WHEN t.sent > coalesce(t.staged, 0) AND coalesce(t.stage, l.stage) = 'new' THEN 'contacted' ELSE coalesce(t.stage, l.stage) END AS stage,
       CASE WHEN t.sent IS NOT NULL THEN {AS_OF_TEXT} ELSE l.last_contacted_at END AS last_contacted_at,
       CASE WHEN t.lead_id IS NOT NULL THEN {AS_OF_TEXT} ELSE l.updated_at END AS updated_at)
FROM present l LEFT JOIN queue_values v ON v.top = l.lead_id LEFT JOIN queue_named t ON t.lead_id = l.lead_id WHERE l.lead_id NOT IN (SELECT lead_id FROM queue_given)""",
    "edited": f"SELECT * REPLACE (CASE WHEN owner = 'Karl Lindt' THEN {AS_OF_TEXT} ELSE last_contacted_at END AS last_contacted_at) FROM leads WHERE owner <> 'Yara Moss'",
    "ordered_hits": "SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
    "by_event": "SELECT printf('Q%05d', user_id) AS question_id, user_id, event_type AS key, count(*)::DOUBLE AS value FROM events GROUP BY ALL",
    "found_pairs": "SELECT least(lead_id, related_lead_id) AS a, greatest(lead_id, related_lead_id) AS b FROM data_issues WHERE issue_type = 'duplicate'",
    "truth_rows": f"""
SELECT 'duplicate' AS issue_type, a, b FROM truth UNION ALL
SELECT 'stale', lead_id, '' FROM leads WHERE stage NOT IN ('won', 'lost') AND coalesce(last_contacted_at, created_at) < TIMESTAMP '2023-10-01' UNION ALL
SELECT 'missing_field', lead_id, 'email' FROM leads WHERE email IS NULL OR trim(email) = ''""",
    "found_rows": """
SELECT issue_type, CASE WHEN issue_type = 'duplicate' THEN least(lead_id, related_lead_id) ELSE lead_id END AS a,
       CASE issue_type WHEN 'duplicate' THEN greatest(lead_id, related_lead_id) WHEN 'missing_field' THEN replace(details, 'Missing ', '') ELSE '' END AS b FROM data_issues""",
    "summaries": """
SELECT run_id, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 4) AS accuracy, count(*) FILTER (answered) AS answered,
       count(*) FILTER (NOT answered) AS declined, round(count(*) FILTER (answered AND valid) / count(*) FILTER (answered), 4) AS citation_valid_rate,
       count(*) FILTER (answered AND NOT valid) AS hallucinated_citations, round(count(*) FILTER (sql_attempts > 1 OR answer_attempts > 1) / count(*), 4) AS retry_rate,
       sum(greatest(sql_attempts - 1, 0)) AS sql_retries, sum(greatest(answer_attempts - 1, 0)) AS answer_retries, round(count(*) FILTER (fallback <> 'none') / count(*), 4) AS fallback_rate,
       count(*) FILTER (fallback = 'template') AS fallback_template, count(*) FILTER (fallback = 'rules') AS fallback_rules, CAST(round_even(avg(latency_ms), 0) AS BIGINT) AS avg_latency_ms,
       quantile_disc(latency_ms, 0.5) AS p50_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms, max(latency_ms) AS max_latency_ms,
       quantile_disc(latency_ms - backoff_ms, 0.5) AS p50_latency_ex_backoff_ms, quantile_disc(latency_ms - backoff_ms, 0.95) AS p95_latency_ex_backoff_ms,
       sum(backoff_ms) AS backoff_ms, sum(tokens) AS tokens, sum(rate_limited) AS rate_limited FROM results GROUP BY run_id""",
}



def over(names: dict[str, str], *chain: str) -> dict[str, str]:
    """Base expressions repeated over other tables: every name in the chain gets the suffix of its source."""
    suffix = next(iter(names.values())).rsplit("_", 1)[1]
    renamed = {**names, **{c: f"{c}_{suffix}" for c in chain}}
    out = {}
    for c in chain:
        body = BASE[c]
        for old, new in renamed.items():
            body = re.sub(rf"\b(FROM|JOIN)\s+{old}\b", rf"\1 {new}", body)
        out[renamed[c]] = body
    return out


CTES["activities_after"] = "SELECT a.activity_id, coalesce(d.primary_id, a.lead_id) AS lead_id, a.type, a.occurred_at FROM activities a LEFT JOIN donors d ON d.lead_id = a.lead_id"
CTES.update(over({"leads": "leads_after", "activities": "activities_after"}, "recent", "parts", "lead_scores"))
CTES["leads_all"] = "SELECT lead_id, company_id, first_name, last_name, email, phone, title, stage, created_at, last_contacted_at FROM leads UNION ALL SELECT lead_id, company_id, first_name, last_name, email, phone, title, stage, created_at, last_contacted_at FROM new_leads"
CTES["companies_all"] = "SELECT company_id, name FROM companies UNION ALL SELECT company_id, name FROM new_companies"
CTES.update(over({"leads": "leads_all", "companies": "companies_all"}, "persons", "mailed", "keyed", "compared", "rated", "full_pairs", "duplicate_pairs", "issue_rows"))
CTES["sides"] = """
SELECT issue_type, lead_id FROM (SELECT issue_type, lead_id FROM issue_rows_all UNION ALL SELECT issue_type, related_lead_id FROM issue_rows_all WHERE related_lead_id IS NOT NULL)
WHERE lead_id IN (SELECT lead_id FROM new_leads)"""
PLAIN_QUESTION = "regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), '^[\"'']+|[\"'']+$', '', 'g'), '\\s+', ' ', 'g'), '[\\s?.!]+$', '')"
STORED = f"""
SELECT kind, left(sha256(kind || chr(31) || 'v1' || chr(31) || {PLAIN_QUESTION}), 16) AS key, '{{{{"item_id":' || CAST(item_id AS VARCHAR) || '}}}}' AS payload
FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'ask' ELSE 'explain' END AS kind FROM benchmark)""".replace("{{", "{").replace("}}", "}")

LIMITED = """
RECURSIVE folded AS (
    SELECT key, event_id, rn, [t] AS hits, TRUE AS admitted, NULL::DOUBLE AS wait_seconds FROM ordered_hits WHERE rn = 1
    UNION ALL
    SELECT key, event_id, rn, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END, len(kept) < 3,
           CASE WHEN len(kept) >= 3 THEN round((86400000000 - (t - kept[1])) / 1e6, 3) END
    FROM (SELECT o.*, list_filter(f.hits, lambda h: o.t - h < 86400000000) AS kept FROM folded f JOIN ordered_hits o ON o.key = f.key AND o.rn = f.rn + 1))"""
LIMIT_FLAGS = "SELECT key, event_id AS hit_id, admitted, wait_seconds FROM folded"

AUDIT_ACTIONS = "coalesce(nullif(purpose, ''), 'other')"
COUNTS = """
SELECT s.issue_type, count(DISTINCT i.lead_id) AS leads FROM (VALUES ('duplicate'), ('stale'), ('missing_field')) s(issue_type) LEFT JOIN sides i ON i.issue_type = s.issue_type GROUP BY 1"""

JOBS = {
    "score_contributions": "SELECT * FROM contributions",
    "score_citations": "SELECT DISTINCT lead_id, ref FROM contributions",
    "score_breakdowns": f"""
SELECT l.lead_id, s.score, s.fit AS fit_points, {FIT_WORDS} AS fit_summary, s.intent AS intent_points, coalesce(t.summary, 'no activity in the last 30 days') AS intent_summary,
       s.recency AS recency_points, {RECENCY_WORDS} AS recency_summary, coalesce(i.refs, '') AS intent_refs
FROM {LC} JOIN lead_scores s ON s.lead_id = l.lead_id LEFT JOIN type_counts t ON t.lead_id = l.lead_id
LEFT JOIN (SELECT lead_id, string_agg(activity_id, ',' ORDER BY place) AS refs FROM (
    SELECT lead_id, activity_id, row_number() OVER (PARTITION BY lead_id ORDER BY points DESC, activity_id) AS place FROM recent) GROUP BY 1) i ON i.lead_id = l.lead_id""",
    "why_now_notes": "SELECT lead_id, note, refs FROM notes",
    "outreach_drafts": f"""
SELECT lead_id, 'Following up on ' || hook AS subject, 'Hi ' || CASE WHEN first_name = upper(first_name) THEN left(first_name, 1) || lower(substr(first_name, 2)) ELSE first_name END
       || ',' || chr(10) || chr(10) || 'Thanks for ' || hook || '. I''d love to understand what ' || firm || ' is looking to solve and whether a short call this week would help.'
       || chr(10) || chr(10) || 'Would Tuesday or Wednesday work?' || chr(10) || chr(10) || split_part(owner, ' ', 1) AS body, concat_ws(',', lead_id, activity_id) AS citations
FROM (SELECT l.lead_id, l.first_name, l.owner, coalesce(c.name, 'your team') AS firm, s.activity_id, coalesce({case('s.type', ACTIVITY_HOOKS)}, 'where things stand') AS hook
      FROM {LC} LEFT JOIN signals s ON s.lead_id = l.lead_id AND s.position = 1)""",
    "note_audit": """
SELECT lead_id AS answer_id, CAST(substr(lead_id, 4) AS INT) % 10 NOT IN (5, 6, 7, 8) AS valid,
       CASE CAST(substr(lead_id, 4) AS INT) % 10 WHEN 5 THEN 'LD-00000' WHEN 7 THEN '[the table]' ELSE '' END AS unknown_ids,
       CASE WHEN CAST(substr(lead_id, 4) AS INT) % 10 = 6 THEN '123456.7' ELSE '' END AS unsupported_numbers,
       CASE CAST(substr(lead_id, 4) AS INT) % 10 WHEN 5 THEN 'cites references that are not row IDs in the query result: LD-00000'
            WHEN 6 THEN 'states numbers not in the query result: 123456.7' WHEN 7 THEN 'cites references that are not row IDs in the query result: [the table]'
            WHEN 8 THEN 'makes claims without citing any row ID' END AS reason FROM leads""",
    "industry_summaries": """
SELECT industry AS answer_id, CAST(max(n) AS VARCHAR) || ' matching rows' || CASE WHEN max(n) > 5 THEN ' (showing 5 of ' || CAST(max(n) AS VARCHAR) || ')' ELSE '' END || ': '
       || string_agg('[' || company_id || '] ' || name, '; ' ORDER BY place) || '.' AS summary
FROM (SELECT *, count(*) OVER (PARTITION BY industry) AS n, row_number() OVER (PARTITION BY industry ORDER BY company_id) AS place FROM companies WHERE industry IS NOT NULL)
WHERE place <= 5 GROUP BY 1""",
    "cited_row_tables": """
SELECT DISTINCT i.id, CASE split_part(i.id, '-', 1) WHEN 'LD' THEN 'leads' WHEN 'CO' THEN 'companies' ELSE 'activities' END AS "table",
       CASE split_part(i.id, '-', 1) WHEN 'LD' THEN i.id WHEN 'ACT' THEN a.lead_id END AS lead_id
FROM (SELECT unnest(regexp_extract_all(note, '(?:LD|CO|ACT|ISS|AX)-[0-9]{4,}')) AS id FROM notes) i LEFT JOIN activities a ON a.activity_id = i.id""",
    "import_outcomes": "SELECT row_no AS row, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons, array_to_string(warnings, '; ') AS warnings FROM judged",
    "import_records": "SELECT * FROM records",
    "import_preview": """
SELECT row_no AS row, array_to_string(reasons, '; ') AS reasons, (SELECT count(*) FROM judged) AS rows, (SELECT count(*) FROM judged WHERE len(reasons) > 0) AS will_reject
FROM judged WHERE len(reasons) > 0 ORDER BY row_no LIMIT 50""",
    "import_companies": "SELECT row, company_id, company_is_new FROM resolved",
    "import_new_companies": "SELECT * FROM new_companies",
    "import_leads": "SELECT * FROM new_leads",
    "import_counts": """
SELECT (SELECT count(*) FROM records) AS imported, (SELECT count(*) FROM judged WHERE len(reasons) > 0) AS rejected,
       (SELECT count(DISTINCT company_id) FROM resolved WHERE NOT company_is_new) AS matched_companies, (SELECT count(*) FROM openers) AS new_companies""",
    "import_audit": f"""
SELECT 1 AS id, 'IMP-00001' AS action_id, 'imported ' || CAST((SELECT count(*) FROM records) AS VARCHAR) || ' leads from export.csv ('
       || CAST((SELECT count(*) FROM judged WHERE len(reasons) > 0) AS VARCHAR) || ' rows rejected)' AS event, TIMESTAMP '2024-01-26 09:00:00' AS at, 'tester' AS actor""",
    "import_csv_files": """
SELECT reason, count(*) AS rows FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM judged) GROUP BY 1""",
    "import_csv_documents": "SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
    "proposal_checks": "SELECT proposal_id, type, error FROM judged_proposals",
    "created_actions": "SELECT action_id, type, lead_list AS lead_ids, payload_json, 'pending' AS status, note FROM made_actions",
    "decided_actions": "SELECT action_id, status, decided_at, decided_by, note FROM decided",
    "decision_conflicts": """SELECT action_id, "at", actor, action_id || ' is already ' || stands AS message FROM ranked_decisions WHERE turn > 1""",
    "batch_plan": "SELECT action_id, state, missing FROM planned",
    "executed_leads": "SELECT * FROM leads_after",
    "queue_outcomes": "SELECT action_id, CASE WHEN missing IS NULL THEN 'run' ELSE 'gone' END AS state, missing FROM queue_run WHERE n > 0",
    "queue_leads": "SELECT * FROM queue_after",
    "queue_failures": "SELECT action_id, 'execution failed: leads no longer exist: ' || missing AS event FROM queue_run WHERE missing IS NOT NULL",
    "queue_activities": """
SELECT a.* REPLACE (coalesce(b.top, a.lead_id) AS lead_id) FROM activities a
LEFT JOIN (SELECT top, node FROM queue_below WHERE top NOT IN (SELECT lead_id FROM queue_given)) b ON b.node = a.lead_id""",
    "executed_activities": "SELECT a.activity_id, coalesce(d.primary_id, a.lead_id) AS lead_id, a.type, a.occurred_at FROM activities a LEFT JOIN donors d ON d.lead_id = a.lead_id",
    "executed_issues": f"""
SELECT lead_id, issue_type, details, related_lead_id FROM data_issues WHERE issue_type = 'duplicate' AND lead_id NOT IN (SELECT lead_id FROM donors)
       AND related_lead_id NOT IN (SELECT lead_id FROM donors) AND lead_id IN (SELECT lead_id FROM present) AND related_lead_id IN (SELECT lead_id FROM present)
UNION ALL SELECT lead_id, issue_type, details, related_lead_id FROM data_issues WHERE issue_type <> 'duplicate' AND lead_id NOT IN (SELECT lead_id FROM touched) AND lead_id IN (SELECT lead_id FROM present)
UNION ALL SELECT lead_id, 'missing_field', 'Missing ' || f, NULL FROM (SELECT lead_id, unnest({noted("CASE WHEN email IS NULL OR trim(email) = '' THEN 'email' END", "CASE WHEN phone IS NULL OR trim(phone) = '' THEN 'phone' END", "CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END")}) AS f
       FROM leads_after WHERE lead_id IN (SELECT lead_id FROM touched))
UNION ALL SELECT lead_id, 'stale', 'Open lead in stage ''' || stage || ''', ' || CASE WHEN last_contacted_at IS NOT NULL THEN 'last contacted ' ELSE 'never contacted, created ' END
       || CAST(CAST(floor((epoch_us({AS_OF_TEXT}) - epoch_us(coalesce(last_contacted_at, created_at))) / 1e6 / 86400) AS BIGINT) AS VARCHAR) || ' days ago', NULL
FROM leads_after WHERE lead_id IN (SELECT lead_id FROM touched) AND stage NOT IN ('won', 'lost') AND coalesce(last_contacted_at, created_at) < {AS_OF_TEXT} - INTERVAL '90' DAY""",
    "executed_audit": """
SELECT d.action_id, CASE WHEN p.state = 'run' THEN 'executed' ELSE d.status END AS status,
       concat_ws(' | ', m.actor || '=created ' || d.type || ' for ' || array_to_string(d.lead_ids, ', '),
           r.actor || '=' || r.verdict || CASE WHEN coalesce(r.note, '') <> '' THEN ': ' || r.note ELSE '' END,
           CASE p.state WHEN 'gone' THEN 'system=execution failed: leads no longer exist: ' || p.missing
                WHEN 'run' THEN 'system=executed: ' || CASE d.type
                    WHEN 'stage_change' THEN 'set stage to ''' || json_extract_string(m.payload_json, '$.stage') || ''' on ' || array_to_string(d.lead_ids, ', ')
                    WHEN 'outreach' THEN 'logged email outreach to ' || array_to_string(d.lead_ids, ', ')
                    ELSE 'merged ' || array_to_string(list_filter(d.lead_ids, lambda x: x <> d.primary_id), ', ') || ' into ' || d.primary_id || ' (moved '
                         || CAST(coalesce(v.moved, 0) AS VARCHAR) || ' activities' || coalesce(', filled ' || nullif(f.filled, ''), '') || ')' END END) AS trail
FROM decided d JOIN made_actions m ON m.action_id = d.action_id LEFT JOIN ranked_decisions r ON r.action_id = d.action_id AND r.turn = 1
LEFT JOIN planned p ON p.action_id = d.action_id
LEFT JOIN (SELECT x.action_id, count(*) AS moved FROM donors x JOIN activities a ON a.lead_id = x.lead_id GROUP BY 1) v ON v.action_id = d.action_id
LEFT JOIN (SELECT l.lead_id, concat_ws(', ', CASE WHEN (l.email IS NULL OR trim(l.email) = '') AND s.email IS NOT NULL THEN 'email' END,
               CASE WHEN (l.phone IS NULL OR trim(l.phone) = '') AND s.phone IS NOT NULL THEN 'phone' END, CASE WHEN (l.title IS NULL OR trim(l.title) = '') AND s.title IS NOT NULL THEN 'title' END) AS filled
           FROM present l JOIN survivors s ON s.primary_id = l.lead_id) f ON f.lead_id = d.primary_id AND d.type = 'merge'""",
    "action_counts": """
SELECT coalesce(status, 'all') AS status, count(*) AS n FROM (
    SELECT CASE WHEN p.state = 'run' THEN 'executed' ELSE d.status END AS status FROM decided d LEFT JOIN planned p ON p.action_id = d.action_id) GROUP BY ROLLUP (status)""",
    "issue_refresh": f"""
SELECT lead_id, issue_type, details, related_lead_id FROM data_issues WHERE lead_id IN (SELECT lead_id FROM edited) AND (related_lead_id IS NULL OR related_lead_id IN (SELECT lead_id FROM edited))
       AND (issue_type <> 'stale' OR lead_id NOT IN (SELECT lead_id FROM leads WHERE owner = 'Karl Lindt'))""",
    "cleaning_metrics": """
SELECT issue_type, CASE WHEN found > 0 THEN round(tp / found, 4) ELSE 0 END AS precision, CASE WHEN expected > 0 THEN round(tp / expected, 4) ELSE 0 END AS recall,
       CASE WHEN tp > 0 THEN round(2 * (tp / found) * (tp / expected) / (tp / found + tp / expected), 4) ELSE 0 END AS f1, found, expected
FROM (SELECT issue_type, count(f) AS found, count(t) AS expected, count(CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN 1 END) AS tp
      FROM (SELECT DISTINCT *, 1 AS f FROM found_rows) FULL JOIN (SELECT DISTINCT *, 1 AS t FROM truth_rows) USING (issue_type, a, b) GROUP BY 1)""",
    "recall_by_kind": "SELECT kind, count(f.a) AS found, count(*) AS total FROM truth t LEFT JOIN (SELECT DISTINCT a, b FROM found_pairs) f ON f.a = t.a AND f.b = t.b GROUP BY 1",
    "unseeded_pairs": """
SELECT p.a, p.b, t.kind AS trap FROM found_pairs p LEFT JOIN (SELECT * FROM truth WHERE kind = 'kind 3') t ON t.a = p.a AND t.b = p.b
WHERE NOT EXISTS (SELECT 1 FROM truth x WHERE x.kind <> 'kind 3' AND x.a = p.a AND x.b = p.b) ORDER BY 1, 2""",
    "trap_hits": "SELECT t.kind, count(*) AS merged FROM truth t WHERE t.kind <> 'kind 1' AND EXISTS (SELECT 1 FROM found_pairs p WHERE p.a = t.a AND p.b = t.b) GROUP BY 1",
    "answer_table": """
SELECT owner AS question_id, 'scalar' AS kind, '' AS key, min_by(s.score, l.lead_id) AS value FROM leads l JOIN lead_scores s ON s.lead_id = l.lead_id GROUP BY 1
UNION ALL SELECT owner, 'id_set', lead_id, NULL FROM leads
UNION ALL SELECT owner, 'table', stage, max_by(s.score, l.lead_id) FROM leads l JOIN lead_scores s ON s.lead_id = l.lead_id GROUP BY 1, 3""",
    "graded_answers": """
SELECT question_id, r.run_id, CASE WHEN user_id % 20 = 19 THEN user_id % 40 = 39 WHEN user_id % 40 = 39 THEN FALSE
       ELSE bool_and(NOT (user_id % 3 = r.run_id AND key = 'error' AND abs(1.0) > greatest(0.051, 0.001 * value))) END AS passed
FROM by_event, (VALUES (0), (1), (2)) r(run_id) GROUP BY question_id, user_id, r.run_id""",
    "run_summary": "SELECT * FROM summaries",
    "passed_by_category": "SELECT run_id, category, count(*) FILTER (passed) AS passed, count(*) AS total FROM results GROUP BY 1, 2",
    "passed_by_source": "SELECT run_id, source, count(*) FILTER (passed) AS passed, count(*) AS total FROM results GROUP BY 1, 2",
    "run_spread": """
SELECT measure, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS stdev, min(value) AS min, max(value) AS max FROM (
    UNPIVOT (SELECT CAST(accuracy AS DOUBLE) AS accuracy, CAST(citation_valid_rate AS DOUBLE) AS citation_valid_rate, CAST(retry_rate AS DOUBLE) AS retry_rate, CAST(fallback_rate AS DOUBLE) AS fallback_rate,
             CAST(p50_latency_ms AS DOUBLE) AS p50_latency_ms, CAST(p95_latency_ms AS DOUBLE) AS p95_latency_ms, CAST(p50_latency_ex_backoff_ms AS DOUBLE) AS p50_latency_ex_backoff_ms,
             CAST(p95_latency_ex_backoff_ms AS DOUBLE) AS p95_latency_ex_backoff_ms FROM summaries) ON COLUMNS(*) INTO NAME measure VALUE value) GROUP BY 1""",
    "question_stability": """
SELECT question_id, passes, CASE WHEN passes = 0 THEN 'always failing' ELSE 'unstable' END AS status
FROM (SELECT question_id, count(*) FILTER (passed) AS passes FROM results GROUP BY 1) WHERE passes < (SELECT count(DISTINCT run_id) FROM results)""",
    "ledger_totals": "SELECT count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, sum(total_tokens) FILTER (ok) AS tokens FROM ledger",
    "ledger_by_purpose": f"SELECT {AUDIT_ACTIONS} AS purpose, sum(total_tokens) AS tokens, count(*) AS calls, sum(total_tokens) // count(*) AS tokens_per_call FROM ledger WHERE ok GROUP BY 1",
    "ledger_errors": "SELECT error, count(*) AS n FROM ledger WHERE NOT ok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "stream_ledger": f"""SELECT left("at", 10) AS day, {AUDIT_ACTIONS} AS purpose, coalesce(sum(total_tokens) FILTER (ok), 0) AS tokens, count(*) FILTER (ok) AS calls, count(*) FILTER (NOT ok) AS failed FROM ledger GROUP BY 1, 2""",
    "stream_intent": "SELECT lead_id, sum(CAST(round(points * 100) AS BIGINT)) AS cents FROM recent GROUP BY 1",
    "stream_scores": "SELECT s.* FROM lead_scores s WHERE EXISTS (SELECT 1 FROM activities a WHERE a.lead_id = s.lead_id)",
    "upsert_reopened": "SELECT lead_id, CASE WHEN stage = 'lost' THEN 'new' ELSE stage END AS stage FROM leads",
    "delete_flagged": "SELECT lead_id, owner FROM leads l WHERE NOT EXISTS (SELECT 1 FROM data_issues i WHERE i.lead_id = l.lead_id)",
    "constraint_violations": """
SELECT * FROM (SELECT 'l_orderkey, l_linenumber not unique' AS violation, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS rows, 'lineitem' AS "table"
UNION ALL SELECT 'doc_id not unique', (SELECT count(*) FROM (SELECT 1 FROM labels GROUP BY doc_id HAVING count(*) > 1)), 'labels'
UNION ALL SELECT 'email is null', (SELECT count(*) FROM leads WHERE email IS NULL), 'leads'
UNION ALL SELECT 'company_id is null', (SELECT count(*) FROM leads WHERE company_id IS NULL), 'leads') WHERE rows > 0""",
    "document_emails": f"""
SELECT {email('e')} AS email, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.]*[A-Za-z0-9]')) AS e FROM documents) GROUP BY 1""",
    "document_folds": """
SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[\\s\\x1c-\\x1f]+', ' ', 'g'))) AS digest FROM documents""",
}
JOBS["reexported_leads"] = """
SELECT n.lead_id, count(*) AS same_email, count(*) FILTER (coalesce(n.company_id, '') = coalesce(o.company_id, '')) AS same_company
FROM leads n JOIN leads o ON lower(trim(o.email)) = lower(trim(n.email))
WHERE (CAST(substr(n.lead_id, 4) AS INT) - 1) % 25 = 24 AND (CAST(substr(o.lead_id, 4) AS INT) - 1) % 25 <> 24 AND trim(n.email) <> '' GROUP BY 1"""
JOBS["overview_with_actions"] = DASHBOARD["overview_totals"].replace(
    "(SELECT count(DISTINCT lead_id) FROM data_issues) AS leads_with_issues)",
    "(SELECT count(DISTINCT lead_id) FROM data_issues) AS leads_with_issues, (SELECT count(*) FROM decided WHERE status = 'pending') AS pending_actions)")
JOBS["health_counts"] = "SELECT (SELECT count(*) FROM leads) AS leads, (SELECT count(*) FROM benchmark) AS entries, TRUE AS ready"
JOBS["executed_scores"] = "SELECT * FROM lead_scores_after"
JOBS["import_issue_counts"] = COUNTS
JOBS["exported_results"] = STORED
JOBS["batched_duplicates"] = "SELECT lead_id, related_lead_id, reason FROM duplicate_pairs"
JOBS["advanced_scores"] = "SELECT lead_id, score, fit, intent, recency FROM lead_scores"
JOBS["advanced_stale"] = "SELECT lead_id, details FROM issue_rows WHERE issue_type = 'stale'"
JOBS["kept_fingerprints"] = """
SELECT 'companies' AS "table", count(*) AS rows, TRUE AS same FROM companies UNION ALL SELECT 'leads', count(*), TRUE FROM queue_after UNION ALL SELECT 'activities', count(*), TRUE FROM activities
UNION ALL SELECT 'data_issues', count(*), TRUE FROM data_issues UNION ALL SELECT 'lead_scores', count(*), TRUE FROM lead_scores"""
JOBS["issue_page_stored"] = f"""
SELECT issue_id, issue_type, details, lead_id, related_lead_id, name, company, owner, stage, score, page::INTEGER AS page, total FROM (
  SELECT *, count(*) OVER () AS total, (row_number() OVER (ORDER BY issue_type, score DESC NULLS LAST, issue_id) - 1) // 20 + 1 AS page FROM ({ISSUE_LIST}))
WHERE page IN (1, greatest(1, total // 40), greatest(1, (total + 19) // 20))"""
JOBS["lead_detail"] = f"""
SELECT 'lead' AS part, l.lead_id AS id, s.score::VARCHAR AS value FROM most_active m JOIN leads l ON l.lead_id = m.lead_id LEFT JOIN lead_scores s ON s.lead_id = l.lead_id
UNION ALL SELECT 'activity', activity_id, type FROM (SELECT a.* FROM activities a JOIN most_active m ON m.lead_id = a.lead_id ORDER BY occurred_at DESC, activity_id LIMIT 50)
UNION ALL SELECT 'issue', issue_id, details FROM data_issues i JOIN most_active m ON m.lead_id IN (i.lead_id, i.related_lead_id)"""
CTES["most_active"] = "SELECT lead_id FROM activities GROUP BY lead_id ORDER BY count(*) DESC, lead_id LIMIT 1"
def _cut(x: str, decimals: int) -> str:
    units = f"floor(({x}) * {10 ** decimals})::BIGINT"
    return f"{units}::VARCHAR" if not decimals else f"(({units}) // 10)::VARCHAR || '.' || (({units}) % 10)::VARCHAR"


CTES["told"] = f"""
SELECT l.lead_id, [l.deal_value, s.score, s.fit, s.intent, s.fit / greatest(s.score, 1.0), 1.0] AS cells,
       'Deal of ' || {_cut('l.deal_value + s.fit / 40', 0)} || ', score ' || {_cut('s.score', 1)} || ' as of 2024-01-26, fit is ' || {_cut('s.fit / greatest(s.score, 1.0) * 100', 1)}
       || '% of it, a third ' || {_cut('s.score / 3', 1)} || ' in 1 row [' || l.lead_id || '].' AS text
FROM leads l JOIN lead_scores s ON s.lead_id = l.lead_id WHERE l.deal_value IS NOT NULL"""
JOBS["number_audit"] = """
SELECT lead_id AS answer_id, count(*) FILTER (NOT held) = 0 AS valid, coalesce(string_agg(token, ' ' ORDER BY place) FILTER (NOT held), '') AS unsupported_numbers FROM (
  SELECT lead_id, token, place, len(list_filter(cells, lambda c: abs(value - c) <= margin OR (token LIKE '%\\%' ESCAPE '\\' AND abs(value - 100 * c) <= margin))) > 0 AS held FROM (
    SELECT *, replace(rtrim(token, '%'), ',', '')::DOUBLE AS value, 0.5 * pow(10, -length(regexp_extract(rtrim(token, '%'), '\\.([0-9]+)$', 1))) + 1e-9 AS margin FROM (
      SELECT lead_id, cells, unnest(found) AS token, generate_subscripts(found, 1) AS place FROM (
        SELECT lead_id, cells, regexp_extract_all(regexp_replace(regexp_replace(text, '(?:LD|CO|ACT|ISS|AX)-[0-9]{4,}', ' ', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', ' ', 'g'), '[0-9][0-9,]*(?:\\.[0-9]+)?%?') AS found FROM told))))
GROUP BY lead_id"""
JOBS["ledger_since"] = "SELECT count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, coalesce(sum(total_tokens) FILTER (ok), 0) AS tokens FROM ledger WHERE \"at\" >= '2024-01-16T12'"
JOBS["latest_companies"] = "SELECT * REPLACE (upper(industry) AS industry), NULL::VARCHAR AS region FROM companies WHERE employees > 100"
JOBS["appended_activities"] = "SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, count(*) AS activities, count(DISTINCT lead_id) AS leads FROM activities GROUP BY 1"
JOBS["rejected_actions"] = "SELECT action_id, decided_by, 2 AS entries FROM decided WHERE status = 'rejected'"
JOBS["file_limits"] = "SELECT unnest(['rows as many', 'one row less', 'few bytes']) AS \"limit\", (SELECT count(*) FROM export_rows) AS rows, unnest([FALSE, TRUE, TRUE]) AS refused"
JOBS["valid_results"] = STORED + " WHERE item_id % 5 <> 1"
RECURSIVE = {"limit_flags": LIMIT_FLAGS, "stream_limit_flags": LIMIT_FLAGS}


def _checksum_sql(table: str, schema: str) -> str:
    """The row count of a table and the sum of the first twelve digits of its rows' MD5."""
    texts = []
    for part in schema.split(", "):
        name, kind = part.split()
        value = {"timestamp_ntz": f"epoch_us({name})", "double": f"CAST(round({name} * 100) AS BIGINT)"}.get(kind, name)
        texts.append(f"coalesce(CAST({value} AS VARCHAR), '~')")
    row = " || '|' || ".join(texts)
    return (f"SELECT '{table}' AS \"table\", count(*) AS rows, CAST(coalesce(sum(CAST('0x' || left(md5({row}), 12) AS HUGEINT)), 0) AS VARCHAR) AS checksum FROM {table}")


JOBS["table_fingerprints"] = " UNION ALL ".join(_checksum_sql(t, SCHEMAS[t]) for t in QUERYABLE_TABLES)
# Latin-1 has no euro sign; it is written as a question mark.
JOBS["import_mixed_exports"] = "SELECT replace(coalesce(COLUMNS(* EXCLUDE (row_no)), ''), '€', CASE WHEN row_no % 2 = 1 THEN '?' ELSE '€' END) FROM export_rows"
