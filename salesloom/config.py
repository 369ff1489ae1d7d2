"""Codes, weights and word lists that decide the results.

Everything in this file is a fixed value. Changing one changes what the jobs answer.
"""

from datetime import datetime

# The frozen clock of the published data set. Jobs take `as_of` explicitly.
AS_OF = datetime(2026, 9, 15, 12, 0, 0)

# Detector and score windows.
STALE_DAYS = 90
INTENT_WINDOW_DAYS = 30
INTENT_HALF_LIFE_DAYS = 10.0
INTENT_MAX = 40.0
RECENCY_MAX = 20.0
FIT_MAX = 40.0

# Stages in business order.
OPEN_STAGES = ("new", "contacted", "qualified", "proposal", "negotiation")
CLOSED_STAGES = ("won", "lost")
ALL_STAGES = OPEN_STAGES + CLOSED_STAGES

ISSUE_TYPES = ("duplicate", "stale", "missing_field")
REQUIRED_FIELDS = ("email", "phone", "title")

# Fit points.
SENIORITY_POINTS = {"c_level": 16, "vp": 14, "director": 11, "manager": 7, "individual": 3}
SENIORITY_LABELS = {"c_level": "C-level", "vp": "VP", "director": "Director", "manager": "Manager", "individual": "IC"}
SIZE_BANDS = ((1000, 14), (200, 12), (50, 8), (10, 4), (0, 1))
INDUSTRY_POINTS = {
    "Software": 10, "Fintech": 10, "Healthcare": 7, "E-commerce": 7,
    "Logistics": 5, "Manufacturing": 4, "Education": 3, "Media": 3,
}
INDUSTRY_DEFAULT_POINTS = 2

# Intent points per activity before decay, and the wording of activities in texts.
INTENT_WEIGHTS = {
    "demo_request": 14.0, "pricing_page_visit": 9.0, "meeting": 8.0, "email_reply": 6.0,
    "call": 4.0, "website_visit": 2.0, "email_open": 1.0,
}
ACTIVITY_LABELS = {
    "demo_request": "requested a demo", "pricing_page_visit": "viewed pricing", "meeting": "took a meeting",
    "email_reply": "replied to email", "call": "took a call", "website_visit": "visited the site",
    "email_open": "opened an email",
}
ACTIVITY_HOOKS = {
    "demo_request": "your demo request", "pricing_page_visit": "your interest in our pricing",
    "meeting": "our recent conversation", "email_reply": "your reply", "call": "our recent call",
    "website_visit": "your recent visit", "email_open": "my last note",
}

# Matching.
EMAIL_LOCAL_THRESHOLD = 85.0
GMAIL_DOMAINS = ("gmail.com", "googlemail.com")
COMPANY_SUFFIXES = (
    "inc", "incorporated", "ltd", "limited", "llc", "llp", "lp", "plc", "corp", "corporation", "co", "company",
    "gmbh", "ag", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "pvt", "private", "pty", "oy", "ab", "kk",
)
NICKNAMES = {
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "libby": "elizabeth",
    "eliza": "elizabeth", "mike": "michael", "mikey": "michael", "mick": "michael", "kate": "katherine",
    "katie": "katherine", "kathy": "katherine", "kat": "katherine", "cathy": "catherine", "jim": "james",
    "jimmy": "james", "jamie": "james", "tom": "thomas", "tommy": "thomas", "dave": "david", "davey": "david",
    "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "chris": "christopher", "topher": "christopher",
    "alex": "alexander", "xander": "alexander", "sam": "samuel", "sammy": "samuel", "dan": "daniel",
    "danny": "daniel", "matt": "matthew", "matty": "matthew", "nick": "nicholas", "nicky": "nicholas",
    "tony": "anthony", "joe": "joseph", "joey": "joseph", "steve": "steven", "stevie": "steven",
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "marge": "margaret", "dick": "richard",
    "rick": "richard", "ricky": "richard", "rich": "richard", "ed": "edward", "eddie": "edward", "ted": "edward",
    "andy": "andrew", "drew": "andrew", "greg": "gregory", "jeff": "jeffrey", "jon": "jonathan",
    "johnny": "john", "jack": "john", "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence",
    "len": "leonard", "pat": "patrick", "patty": "patricia", "trish": "patricia", "pete": "peter",
    "phil": "philip", "ron": "ronald", "ronnie": "ronald", "russ": "russell", "sue": "susan", "suzy": "susan",
    "tim": "timothy", "timmy": "timothy", "vicky": "victoria", "vince": "vincent", "abby": "abigail",
    "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "charlie": "charles",
    "chuck": "charles", "debbie": "deborah", "deb": "deborah", "don": "donald", "donnie": "donald",
    "doug": "douglas", "fred": "frederick", "freddie": "frederick", "gabe": "gabriel", "hank": "henry",
    "harry": "henry", "jake": "jacob", "josh": "joshua", "kim": "kimberly", "max": "maximilian",
    "mandy": "amanda", "manny": "manuel", "nate": "nathan", "pam": "pamela", "ray": "raymond",
    "sandy": "sandra", "tina": "christina", "val": "valerie", "zach": "zachary", "zack": "zachary",
    "pepe": "jose", "paco": "francisco", "nacho": "ignacio", "lupe": "guadalupe", "cesc": "francesc",
}

# Header spellings per target field, most specific first.
HEADER_SPELLINGS = {
    "first_name": ["firstname", "first", "givenname", "fname"],
    "last_name": ["lastname", "last", "surname", "familyname", "lname"],
    "email": ["email", "emailaddress", "workemail", "primaryemail", "businessemail"],
    "phone": ["phonenumber", "phone", "mobilephone", "mobile", "workphone", "businessphone"],
    "title": ["jobtitle", "title", "position", "role"],
    "company": ["companyname", "company", "accountname", "account", "organization", "organisation"],
    "domain": ["companydomainname", "website", "companywebsite", "domain", "websiteurl"],
    "industry": ["industry", "companyindustry"],
    "employees": ["numberofemployees", "employees", "companysize", "employeecount", "headcount"],
    "country": ["countryregion", "country", "companycountry", "mailingcountry"],
    "stage": ["leadstatus", "status", "lifecyclestage", "stage", "dealstage", "leadstage"],
    "source": ["originalsource", "leadsource", "source", "originalsourcetype"],
    "owner": ["contactowner", "leadowner", "owner", "hubspotowner", "ownername", "salesrep"],
    "deal_value": ["amount", "dealamount", "dealvalue", "opportunityamount", "expectedrevenue"],
    "created_at": ["createdate", "createddate", "datecreated", "created", "createdat"],
    "last_contacted_at": ["lastcontacted", "lastcontacteddate", "lastactivitydate", "lastactivity",
                          "lastcontact", "lastengagementdate"],
}
FIELD_LABELS = {
    "first_name": "First name", "last_name": "Last name", "email": "Email", "phone": "Phone", "title": "Job title",
    "company": "Company", "domain": "Company domain", "industry": "Industry", "employees": "Employees",
    "country": "Country", "stage": "Stage", "source": "Source", "owner": "Owner", "deal_value": "Deal value",
    "created_at": "Created", "last_contacted_at": "Last contacted",
}

# Import code maps, keyed by the value in lower case with only letters and digits.
STAGE_CODES = {
    "new": "new", "contacted": "contacted", "qualified": "qualified", "proposal": "proposal",
    "negotiation": "negotiation", "won": "won", "lost": "lost",
    "open": "new", "inprogress": "contacted", "attemptedtocontact": "contacted", "connected": "contacted",
    "opendeal": "proposal", "unqualified": "lost", "badtiming": "lost",
    "subscriber": "new", "lead": "new", "marketingqualifiedlead": "contacted", "mql": "contacted",
    "salesqualifiedlead": "qualified", "sql": "qualified", "opportunity": "proposal", "customer": "won",
    "evangelist": "won", "other": "new",
    "opennotcontacted": "new", "workingcontacted": "contacted", "closedconverted": "won",
    "closednotconverted": "lost", "prospecting": "new", "closedwon": "won", "closedlost": "lost",
}
SOURCE_CODES = {
    "organicsearch": "website", "directtraffic": "website", "website": "website", "web": "website",
    "paidsearch": "website", "referral": "referral", "referrals": "referral", "employeereferral": "referral",
    "socialmedia": "linkedin", "organicsocial": "linkedin", "linkedin": "linkedin", "event": "event",
    "events": "event", "tradeshow": "event", "offlinesources": "event", "emailmarketing": "cold_outbound",
    "outbound": "cold_outbound", "coldcall": "cold_outbound", "coldoutbound": "cold_outbound",
    "partner": "partner", "partnerreferral": "partner",
}
COUNTRY_CODES = {
    "unitedstates": "US", "usa": "US", "us": "US", "unitedstatesofamerica": "US", "unitedkingdom": "GB",
    "uk": "GB", "gb": "GB", "greatbritain": "GB", "england": "GB", "germany": "DE", "deutschland": "DE",
    "de": "DE", "india": "IN", "in": "IN", "canada": "CA", "ca": "CA", "australia": "AU", "au": "AU",
    "france": "FR", "fr": "FR",
}
INDUSTRY_CODES = {
    "software": "Software", "fintech": "Fintech", "healthcare": "Healthcare", "ecommerce": "E-commerce",
    "logistics": "Logistics", "manufacturing": "Manufacturing", "education": "Education", "media": "Media",
    "computersoftware": "Software", "informationtechnologyandservices": "Software", "internet": "Software",
    "saas": "Software", "financialservices": "Fintech", "banking": "Fintech", "hospitalhealthcare": "Healthcare",
    "medicaldevices": "Healthcare", "retail": "E-commerce",
    "logisticsandsupplychain": "Logistics", "transportation": "Logistics", "educationmanagement": "Education",
    "highereducation": "Education", "mediaproduction": "Media", "onlinemedia": "Media",
}
TITLE_LEVELS = (
    (r"\b(chief|ceo|cto|cfo|coo|cro|cmo|cio|founder|co-founder|president|owner)\b", "c_level"),
    (r"\b(vp|svp|evp|vice president)\b", "vp"),
    (r"\b(director|head of)\b", "director"),
    (r"\b(manager|lead|supervisor)\b", "manager"),
)
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DATE_FORMATS = (
    "yyyy-M-d", "yyyy-M-d H:m", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'",
    "M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy h:m a",
)

# Patterns of the evidence audit.
ID_PATTERN = r"\b(?:LD|CO|ACT|ISS|AX)-\d{4,}\b"
DATE_PATTERN = r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?\b"
NUMBER_PATTERN = r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?%?(?![\w])"
CELL_NUMBER_PATTERN = r"-?\d[\d,]*(?:\.\d+)?"
BRACKET_PATTERN = r"\[([^\]]*)\]"

# Order in which a row summary names its columns.
SUMMARY_COLUMNS = ("name", "company", "score", "details", "owner", "industry", "stage", "lead_count", "avg_score")
SUMMARY_LABELED = ("score", "lead_count", "avg_score")
SUMMARY_ROWS = 5

PROMPT_CONTRIBUTIONS = 8
CALL_SHEET_MIN_SCORE = 80
RATE_WINDOW_SECONDS = 60
