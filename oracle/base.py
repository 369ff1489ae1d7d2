"""Common table expressions of the CRM views, scores and issues."""

from salesloom.config import (
    CLOSED_STAGES, COMPANY_SUFFIXES, INDUSTRY_POINTS, INTENT_WEIGHTS, NICKNAMES, OPEN_STAGES, SENIORITY_LABELS,
    SENIORITY_POINTS, SIZE_BANDS,
)
from salesloom.plans.fixture import AS_OF_TEXT, VIEW_SQL


def case(expr: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def days_since(column: str, now: str = AS_OF_TEXT) -> str:
    return f"((epoch_us({now}) - epoch_us({column})) / 1e6 / 86400)"


def one_decimal(expr: str) -> str:
    return f"CAST(printf('%.1f', {expr}) AS DOUBLE)"


def fold(column: str) -> str:
    return f"coalesce(trim(regexp_replace(lower(strip_accents({column})), '\\s+', ' ', 'g')), '')"


def email(column: str) -> str:
    clean = f"lower(trim({column}))"
    return (f"CASE WHEN {column} IS NULL OR {clean} = '' THEN NULL "
            f"WHEN split_part({clean}, '@', 2) IN ('gmail.com', 'googlemail.com') "
            f"THEN replace(split_part(split_part({clean}, '@', 1), '+', 1), '.', '') || '@gmail.com' ELSE {clean} END")


NICK_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in NICKNAMES.items()) + "}"


def formal(expr: str) -> str:
    return f"coalesce(element_at({NICK_MAP}, {expr})[1], {expr})"


def company_key(column: str) -> str:
    words = f"regexp_replace(regexp_replace(replace({fold(column)}, '.', ''), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')"
    return f"trim(regexp_replace(' ' || trim({words}), '( ({'|'.join(COMPANY_SUFFIXES)}))+$', ''))"


def near(a: str, b: str) -> str:
    return f"(greatest(length({a}), length({b})) >= 4 AND damerau_levenshtein({a}, {b}) <= 1)"


def firsts(a: str, b: str, fa: str, fb: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {fa} = {fb} OR {near(a, b)}))"


def lasts(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {near(a, b)}))"


def common_letters(a: str, b: str) -> str:
    """Longest common subsequence of two texts of up to 100 letters."""
    masks = (f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), "
             f"lambda i: CASE WHEN substr({a}, CAST(i AS INT), 1) = c THEN (1::HUGEINT << CAST(i - 1 AS INT)) ELSE 0::HUGEINT END))::HUGEINT)")
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    return (f"(length({a}) - bit_count(list_reduce({masks}, "
            f"lambda v, m: ((v + (v & m)) | (v & xor(m, {full}))) & {full}, {full})))")


def stands(old: str, new: str) -> str:
    """a is the oldest of its class, and b the one that stands for its class beside it."""
    return f"(a.age = a.{old}_first AND b.age = CASE WHEN b.{new}_first > a.age THEN b.{new}_first ELSE b.{new}_last END)"


SIZE_CASE = "CASE " + " ".join(f"WHEN coalesce(c.employees, 0) >= {floor} THEN {p}" for floor, p in SIZE_BANDS) + " ELSE 0 END"
UNKNOWN_SENIORITY = "coalesce(nullif(l.seniority, ''), 'unknown')"
UNKNOWN_INDUSTRY = "coalesce(nullif(c.industry, ''), 'unknown')"
CONTACT_DAYS = days_since("l.last_contacted_at")
RECENCY_CASE = f"""CASE WHEN l.stage IN ({in_list(CLOSED_STAGES)}) THEN 0.0
            WHEN l.last_contacted_at IS NULL THEN 12.0
            WHEN {CONTACT_DAYS} <= 2 THEN 2.0
            WHEN {CONTACT_DAYS} <= 7 THEN {one_decimal(f"2 + ({CONTACT_DAYS} - 2) * 2")}
            WHEN {CONTACT_DAYS} <= 30 THEN 20.0
            ELSE {one_decimal(f"20 * pow(0.5, ({CONTACT_DAYS} - 30) / 30)")} END"""
RECENCY_WORDS = f"""CASE WHEN l.stage IN ({in_list(CLOSED_STAGES)}) THEN 'closed (' || l.stage || '), no follow-up due'
            WHEN l.last_contacted_at IS NULL THEN 'never contacted, first touch due'
            ELSE 'contacted ' || format('{{:.0f}}', {CONTACT_DAYS}) || 'd ago, ' ||
                 CASE WHEN {CONTACT_DAYS} <= 2 THEN 'just touched' WHEN {CONTACT_DAYS} <= 7 THEN 'follow-up coming due'
                      WHEN {CONTACT_DAYS} <= 30 THEN 'follow-up overdue' ELSE 'going cold' END END"""
FIT_WORDS = f"""({case(UNKNOWN_SENIORITY, SENIORITY_LABELS, UNKNOWN_SENIORITY)}) || CASE WHEN c.company_id IS NULL THEN ', company unknown'
            ELSE ' at a ' || CASE WHEN coalesce(c.employees, 0) <> 0 THEN CAST(c.employees AS VARCHAR) || '-person' ELSE 'unknown-size' END
                 || ' ' || coalesce(nullif(c.industry, ''), 'unclassified') || ' company' END"""

CTES: dict[str, str] = {
    **VIEW_SQL,
    "recent": f"""
SELECT activity_id, lead_id, type, age,
       round_even(({case('type', INTENT_WEIGHTS, '0.0')})::DOUBLE * pow(0.5, age / 10), 2) AS points
FROM (SELECT activity_id, lead_id, type, {days_since('occurred_at')} AS age FROM activities)
WHERE age >= 0 AND age <= 30""",
    "parts": f"""
SELECT l.lead_id,
       CAST({case(UNKNOWN_SENIORITY, SENIORITY_POINTS, '0')} AS DOUBLE)
         + CASE WHEN c.company_id IS NULL THEN 0 ELSE {SIZE_CASE} + {case(UNKNOWN_INDUSTRY, INDUSTRY_POINTS, '2')} END AS fit,
       {one_decimal("least(40.0, coalesce(cents, 0) / 100.0)")} AS intent,
       CAST({RECENCY_CASE} AS DOUBLE) AS recency
FROM leads l LEFT JOIN companies c ON c.company_id = l.company_id
LEFT JOIN (SELECT lead_id, sum(CAST(round(points * 100) AS BIGINT)) AS cents FROM recent GROUP BY lead_id) r ON r.lead_id = l.lead_id""",
    "lead_scores": "SELECT lead_id, round(fit + intent + recency, 1) AS score, fit, intent, recency FROM parts",
    "persons": f"""
SELECT l.lead_id, l.created_at, coalesce(nullif({company_key('c.name')}, ''), 'id:' || coalesce(l.company_id, 'None')) AS block,
       {fold('l.first_name')} AS first, {fold('l.last_name')} AS last, {email('l.email')} AS email,
       CASE WHEN length(regexp_replace(l.phone, '\\D', '', 'g')) >= 7
            THEN right(regexp_replace(l.phone, '\\D', '', 'g'), 10) END AS phone
FROM leads l LEFT JOIN companies c ON c.company_id = l.company_id""",
    "keyed": """
SELECT *, first_value(lead_id) OVER (PARTITION BY email ORDER BY created_at, lead_id) AS email_center,
       first_value(lead_id) OVER (PARTITION BY block, first, last, phone ORDER BY created_at, lead_id) AS phone_center,
       first_value(lead_id) OVER (PARTITION BY block, first, last, email IS NULL, mail_key ORDER BY created_at, lead_id) AS key_center,
       arg_min(lead_id, age) FILTER (email IS NULL) OVER named AS lacking_center,
       min(age) OVER named AS name_first, max(age) OVER named AS name_last, count(*) OVER named AS name_n,
       min(age) FILTER (email IS NULL) OVER named AS bare_first, max(age) FILTER (email IS NULL) OVER named AS bare_last, count(*) FILTER (email IS NULL) OVER named AS bare_n,
       min(age) OVER phoned AS phone_first, max(age) OVER phoned AS phone_last, count(*) OVER phoned AS phone_n,
       min(age) OVER written AS key_first, max(age) OVER written AS key_last, count(*) OVER written AS key_n
FROM (SELECT *, {'t': created_at, 'id': lead_id} AS age FROM mailed)
WINDOW named AS (PARTITION BY block, first, last), phoned AS (PARTITION BY block, first, last, phone), written AS (PARTITION BY block, first, last, email IS NULL, mail_key)""",
    "mailed": f"""
SELECT *, {formal('first')} AS first_formal, {formal('last')} AS last_formal,
       {formal("split_part(local, '.', 1)")} || CASE WHEN strpos(local, '.') > 0 THEN substr(local, strpos(local, '.')) ELSE '' END AS mail_key
FROM (SELECT *, regexp_replace({fold("split_part(email, '@', 1)")}, '[._-]+', '.', 'g') AS local FROM persons)""",
    "compared": f"""
SELECT b.lead_id, a.lead_id AS related_lead_id, a.email AS email_a, b.email AS email_b, a.mail_key AS key_a, b.mail_key AS key_b,
       a.phone = b.phone AS same_phone, a.email IS NULL OR b.email IS NULL AS lacks_email, coalesce(a.email = b.email, FALSE) AS same_email,
       a.lead_id = b.email_center AS from_email, a.lead_id = b.phone_center AS from_phone, a.lead_id = b.key_center AS from_key,
       b.lacking_center IN (a.lead_id, b.lead_id) AS from_lacking,
       coalesce(a.phone = b.phone AND {stands("phone", "phone")}, FALSE) AS rep_phone,
       a.email IS NULL AND {stands("bare", "name")} AS rep_bare_old, b.email IS NULL AND {stands("name", "bare")} AS rep_bare_new,
       a.email IS NOT NULL AND b.email IS NOT NULL AND {stands("key", "key")} AS rep_key,
       a.block, a.phone, a.first AS first_old, a.last AS last_old, b.first AS first_new, b.last AS last_new,
       a.phone_n AS phone_old, b.phone_n AS phone_new, a.key_n AS key_old, b.key_n AS key_new, a.name_n AS name_old, b.name_n AS name_new, a.bare_n AS bare_old, b.bare_n AS bare_new,
       CASE WHEN a.block <> b.block THEN NULL
            WHEN {firsts('a.first', 'b.first', 'a.first_formal', 'b.first_formal')} AND {lasts('a.last', 'b.last')}
            THEN CASE WHEN a.first = b.first AND a.last = b.last THEN 'same name' ELSE 'matching name' END
            WHEN {firsts('a.first', 'b.last', 'a.first_formal', 'b.last_formal')} AND {lasts('a.last', 'b.first')}
            THEN 'swapped first/last name' END AS why
FROM keyed a JOIN keyed b ON (a.block = b.block OR a.email = b.email)
     AND (a.created_at < b.created_at OR (a.created_at = b.created_at AND a.lead_id < b.lead_id))""",
    "rated": f"""
SELECT *, CASE WHEN NOT lacks_email AND NOT same_email AND why IS NOT NULL THEN
       (1 - (length(key_a) + length(key_b) - 2 * {common_letters('key_a', 'key_b')})::DOUBLE / (length(key_a) + length(key_b))) * 100 END AS ratio
FROM compared WHERE same_email OR why IS NOT NULL""",
    "duplicate_pairs": """
SELECT lead_id, related_lead_id, reason FROM full_pairs
WHERE CASE WHEN same_email THEN from_email
           WHEN why <> 'same name' THEN rep_phone OR rep_bare_old OR rep_bare_new OR (rep_key AND coalesce(ratio >= 85, FALSE))
           WHEN lacks_email THEN from_lacking OR coalesce(same_phone AND from_phone, FALSE)
           WHEN key_a = key_b THEN from_key OR coalesce(same_phone AND from_phone, FALSE)
           ELSE (ratio >= 85 AND rep_key) OR coalesce(same_phone AND from_phone, FALSE) END""",
    "full_pairs": """
SELECT * FROM (
    SELECT *,
           CASE WHEN same_email THEN 'same email (' || email_a || ')'
                WHEN ratio >= 85 THEN why || ' and similar email (' || format('{:.0f}', ratio) || ') at same company'
                WHEN same_phone THEN why || ' and same phone at same company'
                WHEN lacks_email THEN why || ' at same company, email missing on one record' END AS reason
    FROM rated) WHERE reason IS NOT NULL""",
    "issue_rows": f"""
SELECT lead_id, 'duplicate' AS issue_type, 'Likely duplicate of ' || related_lead_id || ': ' || reason AS details,
       related_lead_id, 0 AS kind_order FROM duplicate_pairs
UNION ALL
SELECT lead_id, 'stale', 'Open lead in stage ''' || stage || ''', ' ||
       CASE WHEN last_contacted_at IS NOT NULL THEN 'last contacted ' ELSE 'never contacted, created ' END ||
       CAST(CAST(floor({days_since('coalesce(last_contacted_at, created_at)')}) AS BIGINT) AS VARCHAR) || ' days ago', NULL, 3
FROM leads WHERE stage IN ({in_list(OPEN_STAGES)}) AND coalesce(last_contacted_at, created_at) < {AS_OF_TEXT} - INTERVAL '90' DAY
UNION ALL SELECT lead_id, 'missing_field', 'Missing email', NULL, 4 FROM leads WHERE email IS NULL OR trim(email) = ''
UNION ALL SELECT lead_id, 'missing_field', 'Missing phone', NULL, 5 FROM leads WHERE phone IS NULL OR trim(phone) = ''
UNION ALL SELECT lead_id, 'missing_field', 'Missing title', NULL, 6 FROM leads WHERE title IS NULL OR trim(title) = ''""",
    "data_issues": """
SELECT printf('ISS-%05d', row_number() OVER (ORDER BY kind_order, lead_id, related_lead_id)) AS issue_id,
       lead_id, issue_type, details, related_lead_id FROM issue_rows""",
}


def with_ctes(query: str, extra: dict[str, str] | None = None) -> str:
    """The query behind the expressions it needs."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in known.items():
            if name not in needed and body != text and _mentions(text, name):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + query


def _mentions(text: str, name: str) -> bool:
    import re
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) is not None
