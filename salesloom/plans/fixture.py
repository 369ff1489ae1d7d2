"""CRM views over the given benchmark tables.

The given tables are not CRM tables. These views derive leads, companies and activities from customers,
suppliers, orders and events by fixed rules on the keys, with noise of every kind the detectors look
for. The expressions mean the same in Spark and in ANSI SQL, so the reference queries start from the
same text.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

FIXTURE_AS_OF = datetime(2024, 1, 25, 12, 0, 0)
AS_OF_TEXT = "TIMESTAMP '2024-01-25 12:00:00'"


def _pick(expr: str, values: list[str | None]) -> str:
    """The value at the position (from 0) an integer expression gives."""
    listed = "|".join("-" if v is None else v for v in values)
    return f"nullif(split_part('{listed}', '|', CAST({expr} AS INT) + 1), '-')"


def _fold_key(column: str, step: int, size: int) -> str:
    return f"(CAST(floor({column} / {step}) AS BIGINT) % {size})"


FIRST_NAMES = ["Robert", "Elizabeth", "Michael", "Katherine", "Thomas", "Jennifer", "Daniel", "Margaret", "José",
               "Müller", "Anthony", "Rebecca", "Ann", "Joe", "Samuel", "Christina", "François", "Victoria"]
SHORT_NAMES = ["Bob", "Liz", "Mike", "Kate", "Tom", "Jen", "Dan", "Peggy", "Pepe",
               "Muller", "Tony", "Becky", "Ann", "Joseph", "Sam", "Tina", "Francois", "Vicky"]
LAST_NAMES = ["Gonzalez", "Smith", "Lee", "Novak", "Rossi", "Garcia", "Jackson", "Riggs", "Freitas", "Lopez",
              "Okafor", "Tanaka", "Schmidt", "Dubois", "Larsen", "Nguyen", "Patel", "Kovacs", "Ng", "Moreau",
              "Fischer", "Santos", "Ivanova"]
TYPO_NAMES = ["Gonzales", "Smiht", "Lee", "Novack", "Rosi", "Garcai", "Jakson", "Rigs", "Freitass", "Lopes",
              "Okafro", "Tanaca", "Schmitd", "Duboi", "Larsne", "Nguyenn", "Patle", "Kovac", "Ng", "Moreua",
              "Fisher", "Santso", "Ivanov"]
OWNERS = ["Ines Vogt", "Otto Brandt", "Lena Hoek", "Karl Lindt", "Nora Falk", "Emil Roth", "Yara Moss",
          "Paul Stein"]
STAGES = ["new", "contacted", "qualified", "proposal", "negotiation", "won", "lost", "new", "contacted"]
SENIORITIES = ["c_level", "vp", "director", "manager", "individual", "individual", None]
SOURCES = ["website", "referral", "linkedin", "event", "cold_outbound", "partner"]
TITLES = ["Chief Executive Officer", "VP of Sales", "Director of Operations", "Account Manager", "Engineer", "Analyst",
          None, "", " ", "Head of Data", "Software Engineer"]
INDUSTRIES = ["Software", "Fintech", "Healthcare", "E-commerce", "Logistics", "Manufacturing", "Education", "Media",
              "Mining", None]
COUNTRIES = ["US", "GB", "DE", "IN", "CA", "AU", "FR"]
SECTORS = ["Systems", "Labs", "Logistics", "Health", "Capital", "Media", "Foods", "Analytics", "Robotics", "Energy"]
SUFFIXES = ["Inc", "Ltd.", "LLC", "Pvt Ltd", "GmbH", "S.A.", "Limited", "Corp", "B.V."]
ACTIVITY_TYPES = ["demo_request", "pricing_page_visit", "meeting", "email_reply", "call", "website_visit", "email_open"]

COMPANIES_SQL = f"""
SELECT printf('CO-%05d', s_suppkey + 1) AS company_id,
       concat('Firm ', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS VARCHAR(20)), ' ',
              {_pick(_fold_key('s_suppkey', 2, 10), SECTORS)}, ' ', {_pick('(s_suppkey % 9)', SUFFIXES)}) AS name,
       CASE WHEN s_suppkey % 11 = 10 THEN NULL
            ELSE concat('firm', CAST(s_suppkey AS VARCHAR(20)), '.com') END AS domain,
       {_pick('(s_suppkey % 10)', INDUSTRIES)} AS industry,
       CASE WHEN s_suppkey % 13 = 12 THEN NULL WHEN s_suppkey % 13 = 11 THEN 0
            ELSE CAST((s_suppkey * 373) % 8000 + 5 AS INT) END AS employees,
       {_pick('(s_suppkey % 7)', COUNTRIES)} AS country,
       TIMESTAMP '2022-03-01 00:00:00' AS created_at
FROM supplier"""

# Key 25k+24 is a noisy copy of key 25k+23: same person (`src`), changed by the kind of the copy.
_COPIED = """
SELECT c_custkey AS k,
       CASE WHEN c_custkey % 25 = 24 THEN c_custkey - 1 ELSE c_custkey END AS src,
       CASE WHEN c_custkey % 25 = 24 THEN CAST(floor(c_custkey / 25) AS BIGINT) % 6 ELSE -1 END AS kind
FROM customer"""

_PEOPLE = f"""
SELECT k, src, kind, CAST(floor(src / 15) AS BIGINT) AS firm,
       {_pick("(src % 18)", FIRST_NAMES)} AS first, {_pick("(src % 18)", SHORT_NAMES)} AS short,
       {_pick(_fold_key("src", 3, 23), LAST_NAMES)} AS last, {_pick(_fold_key("src", 3, 23), TYPO_NAMES)} AS typo,
       CASE WHEN src % 8 = 7 THEN 'gmail.com' ELSE 'firm.com' END AS mail_domain,
       CAST(2000000000 + (src * 7919) % 900000000 AS VARCHAR(20)) AS digits
FROM ({_COPIED}) copied"""

# The join keeps the person columns apart from the expressions below, so none is written out many times.
_SEEDED = f"""
SELECT p.*, concat(lower(short), '.', lower(last), CAST(src % 1000 AS VARCHAR(20)), '@', mail_domain) AS mail, o.amount AS amount
FROM ({_PEOPLE}) p LEFT JOIN (
    SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY o_custkey
) o ON o_custkey = k"""

LEADS_SQL = f"""
SELECT printf('LD-%05d', k + 1) AS lead_id,
       CASE WHEN src % 17 = 16 THEN NULL
            WHEN kind = 2 THEN printf('CO-%05d', firm + 2 - 2 * (firm % 2))
            ELSE printf('CO-%05d', firm + 1) END AS company_id,
       CASE kind WHEN 0 THEN upper(first) WHEN 1 THEN short WHEN 4 THEN last
            ELSE first END AS first_name,
       CASE kind WHEN 0 THEN lower(last) WHEN 3 THEN typo WHEN 4 THEN first
            WHEN 5 THEN concat('  ', last, ' ') ELSE last END AS last_name,
       CASE WHEN kind = 4 THEN NULL
            WHEN kind = 5 THEN concat(' ', upper(mail), '  ')
            WHEN kind = 0 THEN concat('x', mail)
            WHEN kind IN (1, 2, 3) AND src % 2 = 0 THEN concat('team', CAST(k AS VARCHAR(20)), '@other.org')
            WHEN k % 41 = 11 THEN NULL WHEN k % 41 = 12 THEN '' WHEN k % 41 = 13 THEN ' '
            ELSE mail END AS email,
       CASE WHEN k % 43 = 5 THEN NULL WHEN k % 43 = 6 THEN ' '
            WHEN kind >= 0 THEN concat('+1 (', substr(digits, 1, 3), ') ', substr(digits, 4, 3), '-', substr(digits, 7, 4))
            ELSE digits END AS phone,
       {_pick('(k % 11)', TITLES)} AS title,
       {_pick('(k % 7)', SENIORITIES)} AS seniority,
       {_pick('(k % 6)', SOURCES)} AS source,
       {_pick('(k % 9)', STAGES)} AS stage,
       CASE WHEN k % 10 = 9 THEN NULL ELSE amount END AS deal_value,
       {_pick('(k % 8)', OWNERS)} AS owner,
       CASE WHEN k % 29 = 0 THEN {AS_OF_TEXT} - INTERVAL '90' DAY
            WHEN k % 5 = 0 THEN {AS_OF_TEXT} - INTERVAL '20' DAY
            WHEN k % 5 = 1 THEN TIMESTAMP '2023-06-10 08:30:00'
            WHEN k % 5 = 2 THEN TIMESTAMP '2023-11-20 17:45:00'
            WHEN k % 5 = 3 THEN TIMESTAMP '2023-09-01 00:00:00'
            ELSE TIMESTAMP '2023-12-24 09:15:30' END AS created_at,
       CASE WHEN k % 12 = 0 OR k % 29 = 0 THEN NULL
            WHEN k % 12 = 1 THEN {AS_OF_TEXT} - INTERVAL '1' DAY
            WHEN k % 12 = 2 THEN {AS_OF_TEXT} - INTERVAL '2' DAY
            WHEN k % 12 = 3 THEN {AS_OF_TEXT} - INTERVAL '5' DAY
            WHEN k % 12 = 4 THEN TIMESTAMP '2024-01-20 07:41:13'
            WHEN k % 12 = 5 THEN {AS_OF_TEXT} - INTERVAL '7' DAY
            WHEN k % 12 = 6 THEN {AS_OF_TEXT} - INTERVAL '30' DAY
            WHEN k % 12 = 7 THEN TIMESTAMP '2023-12-02 10:20:30'
            WHEN k % 12 = 8 THEN {AS_OF_TEXT} - INTERVAL '90' DAY
            WHEN k % 12 = 9 THEN {AS_OF_TEXT} - INTERVAL '91' DAY
            WHEN k % 12 = 10 THEN TIMESTAMP '2023-08-15 23:59:59'
            ELSE {AS_OF_TEXT} - INTERVAL '15' DAY END AS last_contacted_at,
       TIMESTAMP '2024-01-02 00:00:00' AS updated_at
FROM ({_SEEDED}) seeded"""

ACTIVITIES_SQL = f"""
SELECT printf('ACT-%05d', event_id + 1) AS activity_id,
       printf('LD-%05d', user_id * 10 + CASE WHEN event_id % 10 >= 8 THEN event_id % 3 ELSE event_id % 10 END + 1) AS lead_id,
       {_pick('(event_id % 7)', ACTIVITY_TYPES)} AS type,
       CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL '20' DAY ELSE ts END AS occurred_at
FROM events"""

VIEW_SQL = {"companies": COMPANIES_SQL, "leads": LEADS_SQL, "activities": ACTIVITIES_SQL}


def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crm_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the three base views as a lazy DataFrame."""
    sources = {"companies": ["supplier"], "leads": ["customer", "orders"], "activities": ["events"]}[name]
    text = VIEW_SQL[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    for table in sources:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **{table: given_table(spark, sf_dir, table) for table in sources})


# ------------------------------------------------------------------ inputs of the other operators

# A CRM export as text, one row per customer: known and new companies, several number and date formats, bad values.
EXPORT_SQL = f"""
SELECT c_custkey + 2 AS row_no,
       CASE WHEN c_custkey % 31 = 4 THEN '' ELSE {_pick("(c_custkey % 18)", FIRST_NAMES)} END AS first_name,
       CASE WHEN c_custkey % 31 = 4 THEN '' ELSE concat(' ', {_pick("(c_custkey % 23)", LAST_NAMES)}) END AS last_name,
       CASE WHEN c_custkey % 31 IN (4, 5) THEN '' WHEN c_custkey % 31 = 6 THEN 'bad@' WHEN c_custkey % 31 = 7 THEN 'two words@x.com'
            ELSE concat('person', CAST(c_custkey AS VARCHAR(20)), '@export.com ') END AS email,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(4155550000 + c_custkey AS VARCHAR(20)) END AS phone,
       coalesce({_pick("(c_custkey % 11)", TITLES)}, '') AS title,
       CASE WHEN c_custkey % 37 = 8 THEN ' ' WHEN c_custkey % 4 = 0 THEN concat('firm ', CAST(c_custkey % 40 AS VARCHAR(20)), ' systems inc')
            WHEN c_custkey % 4 = 1 THEN 'Hot Company' ELSE concat('New Co ', CAST(CAST(floor(c_custkey / 9) AS BIGINT) % 200 AS VARCHAR(20))) END AS company,
       CASE WHEN c_custkey % 5 = 0 THEN concat('https://www.Firm', CAST(c_custkey % 150 AS VARCHAR(20)), '.com/')
            WHEN c_custkey % 5 = 1 THEN concat('newco', CAST(CAST(floor(c_custkey / 11) AS BIGINT) % 90 AS VARCHAR(20)), '.io') ELSE '' END AS domain,
       {_pick("(c_custkey % 6)", ["Computer Software", "banking", "Mining", "", "Retail", "Media"])} AS industry,
       {_pick("(c_custkey % 8)", ["51-200", "1,200", "10+", "", "many", "7", "900", "5000+"])} AS employees,
       {_pick("(c_custkey % 6)", ["United Kingdom", "usa", "Deutschland", "Spain", "", "FR"])} AS country,
       {_pick("(c_custkey % 7)", ["Open Deal", "Closed - Converted", "Unqualified", "Nurture", "", "MQL", "in progress"])} AS stage,
       {_pick("(c_custkey % 6)", ["Organic Search", "Word of mouth", "", "Trade Show", "PARTNER", "???"])} AS source,
       {_pick("(c_custkey % 3)", ["Ines Vogt", "", "Paul Stein"])} AS owner,
       {_pick("(c_custkey % 9)", ["$12,500.00", "", "99.5", "€ 1 000", "TBD", "0", "1500+", "20-40", "7"])} AS deal_value,
       {_pick("(c_custkey % 7)", ["2023-11-02", "", "11/20/2023", "2023-12-24 08:30", "not a date", "2024-03-01", "2023-10-05T06:07:08Z"])} AS created_at,
       {_pick("(c_custkey % 5)", ["", "1/5/2024", "2024-01-20 10:11:12", "12/31/2023 11:59 pm", "2024-01-25"])} AS last_contacted_at
FROM customer"""

# Proposed changes, one for each lead; some break a rule.
PROPOSALS_SQL = f"""
SELECT c_custkey AS proposal_id,
       {_pick("(CAST(floor(c_custkey / 10) AS BIGINT) % 3)", ["stage_change", "outreach", "merge"])} AS type,
       CASE WHEN c_custkey % 70 = 60 THEN printf('LD-%05d,LD-%05d', c_custkey + 1, c_custkey + 900001)
            WHEN c_custkey % 110 = 100 THEN printf('LD-%05d,LD-%05d', c_custkey + 1, c_custkey + 1)
            WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 3 = 0 AND c_custkey % 4 = 0 THEN printf('LD-%05d', c_custkey + 1)
            WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 5 = 4 THEN printf('LD-%05d,LD-%05d,LD-%05d', c_custkey + 1, c_custkey + 2, c_custkey + 11)
            ELSE printf('LD-%05d,LD-%05d', c_custkey + 2, c_custkey + 1) END AS lead_list,
       CASE CAST(floor(c_custkey / 10) AS BIGINT) % 3
            WHEN 0 THEN CASE WHEN c_custkey % 130 = 0 THEN '{{{{"stage":"bogus"}}}}' ELSE '{{{{"stage":"won"}}}}' END
            WHEN 1 THEN CASE WHEN c_custkey % 140 = 10 THEN '{{{{"subject":" ","body":"x"}}}}' ELSE '{{{{"subject":"Hi","body":"Checking in."}}}}' END
            ELSE CASE WHEN c_custkey % 150 = 20 THEN '{{{{"primary_id":"LD-00000"}}}}' WHEN c_custkey % 60 = 20 THEN '{{{{}}}}'
                      ELSE printf('{{{{"primary_id":"LD-%05d"}}}}', c_custkey + 1) END END AS payload_json,
       'alice' AS actor, CASE WHEN c_custkey % 20 = 0 THEN 'please check' END AS note
FROM customer"""

# Decisions on the actions made from these proposals; some actions are decided twice.
DECISIONS_SQL = f"""
SELECT printf('AX-%05d', c_custkey + 1) AS action_id,
       CASE WHEN c_custkey % 4 = 3 THEN 'rejected' ELSE 'approved' END AS verdict,
       CASE WHEN c_custkey % 2 = 0 THEN 'bob' ELSE 'carol' END AS actor,
       CASE WHEN c_custkey % 6 = 3 THEN 'not yet' END AS note,
       {AS_OF_TEXT} + INTERVAL '1' HOUR * (c_custkey % 50) AS at
FROM customer
UNION ALL
SELECT printf('AX-%05d', c_custkey + 1), 'rejected', 'dan', NULL, {AS_OF_TEXT} + INTERVAL '25' HOUR
FROM customer WHERE c_custkey % 5 = 0"""

# Calls of a ledger, one per event.
LEDGER_SQL = """
SELECT concat(substr(CAST(ts AS VARCHAR(40)), 1, 10), 'T', substr(CAST(ts AS VARCHAR(40)), 12, 8), '+00:00') AS at,
       'provider' AS provider, 'model' AS model,
       CASE event_type WHEN 'click' THEN 'ask' WHEN 'view' THEN 'explain' WHEN 'purchase' THEN 'draft' ELSE '' END AS purpose,
       event_type <> 'error' AS ok,
       CAST(floor(value) AS BIGINT) AS total_tokens, user_id % 3 AS rate_limit_retries, event_id % 5000 AS latency_ms,
       CASE WHEN event_type = 'error' THEN concat('timeout ', CAST(event_id % 7 AS VARCHAR(20))) END AS error
FROM events"""

# Graded answers of three runs, one per event: question = user, run = event modulo 3.
RESULTS_SQL = """
SELECT printf('Q%05d', user_id) AS question_id, event_id % 3 AS run_id, event_type AS category,
       CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'rules' ELSE 'llm' END AS source,
       (user_id % 10 = 0 OR (event_id + user_id) % 9 > 1) AND user_id % 13 <> 12 AS passed,
       event_id % 4 <> 0 AS answered, event_id % 11 <> 10 AS valid, event_id % 3 + 1 AS sql_attempts, event_id % 2 + 1 AS answer_attempts,
       CASE event_id % 5 WHEN 0 THEN 'template' WHEN 1 THEN 'rules' ELSE 'none' END AS fallback,
       (event_id * 7919) % 10007 AS latency_ms, (event_id % 6) * 100 AS backoff_ms, event_id % 900 AS tokens, event_id % 2 AS rate_limited
FROM events"""

# Known copies in the lead view and what kind of copy each is.
TRUTH_SQL = """
SELECT printf('LD-%05d', c_custkey) AS a, printf('LD-%05d', c_custkey + 1) AS b,
       concat('kind ', CAST(CAST(floor(c_custkey / 25) AS BIGINT) % 6 AS VARCHAR(20))) AS kind
FROM customer WHERE c_custkey % 25 = 24"""

INPUT_SQL = {"export_rows": (EXPORT_SQL, "customer"), "proposals": (PROPOSALS_SQL, "customer"), "decisions": (DECISIONS_SQL, "customer"),
             "ledger": (LEDGER_SQL, "events"), "results": (RESULTS_SQL, "events"), "truth": (TRUTH_SQL, "customer")}


def dealt(df: DataFrame, rows_per_task: int) -> DataFrame:
    """The same rows over as many tasks as their number asks for: a small file of few row groups is read by few, however many rows it has."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(most, -(-df.count() // rows_per_task))))


def input_view(spark: SparkSession, sf_dir: str, name: str, rows_per_task: int | None = None) -> DataFrame:
    """An input; with `rows_per_task` its table, of which only the columns read are shuffled, is dealt over tasks first."""
    text, table = INPUT_SQL[name]
    text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace(f"FROM {table}", f"FROM {{{table}}}")
    given = given_table(spark, sf_dir, table)
    return spark.sql(text, **{table: given if rows_per_task is None else dealt(given, rows_per_task)})


def plain_sql(name: str) -> str:
    """The text of an input view for the SQL side."""
    return INPUT_SQL[name][0].replace("{{", "{").replace("}}", "}")
