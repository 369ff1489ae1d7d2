"""CSV rows to validated records, companies and leads."""

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.config import (
    COUNTRY_CODES, EMAIL_PATTERN, FIELD_LABELS, INDUSTRY_CODES, ISSUE_TYPES, SOURCE_CODES, STAGE_CODES,
)
from salesloom.functions.clock import instant
from salesloom.functions.lookup import look_up
from salesloom.functions.parse import clean_domain, parse_date, parse_number, seniority_from_title
from salesloom.functions.text import code_key, strip
from salesloom.operators.ordering import with_ids
from salesloom.operators.quality import detect_issues
from salesloom.operators.scoring import rescore
from salesloom.sources.csv_files import ROW
from salesloom.sources.storage import written

RECORD_FIELDS = ["first_name", "last_name", "email", "company", "domain", "phone", "title", "seniority", "industry", "country",
                 "owner", "source", "stage", "employees", "deal_value", "created_at", "last_contacted_at"]
LEAD_COLUMNS = ["lead_id", "company_id", "first_name", "last_name", "email", "phone", "title", "seniority", "source", "stage",
                "deal_value", "owner", "created_at", "last_contacted_at", "updated_at"]
COMPANY_COLUMNS = ["company_id", "name", "domain", "industry", "employees", "country", "created_at"]
# Rows of one window when names are followed through the file; a very frequent name spans many buckets.
ROWS_PER_BUCKET = 10_000


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def _texts(*options: Column) -> Column:
    return F.filter(F.array(*options), lambda t: t.isNotNull())


def outcomes(rows: DataFrame, mapping: Mapping[str, str | None], as_of: datetime) -> DataFrame:
    """Per row: `_row`, `record` (NULL when rejected), all `reasons` and all `warnings`."""
    cells = {t: (strip(F.col(f"`{h}`")) if h else F.lit("")).alias(t) for t, h in mapping.items()}
    raw = rows.select(ROW, *cells.values())
    parsed = raw.select(
        "*",
        parse_number(F.col("employees")).alias("_employees"), parse_number(F.col("deal_value")).alias("_deal"),
        parse_date(F.col("created_at")).alias("_created"), parse_date(F.col("last_contacted_at")).alias("_contacted"),
        look_up(STAGE_CODES, code_key(F.col("stage"))).alias("_stage"),
    ).withColumn("_staff", F.when(~F.isnan("_employees"), F.col("_employees").try_cast("int")))

    def quoted(before: str, value: str, after: str) -> Column:
        return F.concat(F.lit(f"{before} '"), F.col(value), F.lit(f"'{after}"))

    def not_a_number(field: str, parsed_column: str) -> Column:
        bad = (F.col(field) != "") & F.col(parsed_column).isNull()
        return F.when(bad, quoted(FIELD_LABELS[field].lower(), field, " is not a number"))

    def bad_date(field: str, parsed_column: str) -> Column:
        given = F.col(field) != ""
        label = f"{FIELD_LABELS[field].lower()} date"
        return (F.when(given & F.col(parsed_column).isNull(), quoted(label, field, " is not recognized"))
                .when(given & (F.col(parsed_column) > instant(as_of)), quoted(label, field, " is after the data as-of date")))

    no_name = (F.col("first_name") == "") & (F.col("last_name") == "")
    reasons = _texts(
        F.when((F.col("email") != "") & ~F.col("email").rlike(EMAIL_PATTERN), quoted("invalid email", "email", "")),
        F.when((F.col("email") == "") & no_name, "no name and no email"),
        F.when(F.col("company") == "", "no company"),
        not_a_number("employees", "_staff"), not_a_number("deal_value", "_deal"),
        bad_date("created_at", "_created"), bad_date("last_contacted_at", "_contacted"),
    )
    warnings = _texts(
        F.when((F.col("stage") != "") & F.col("_stage").isNull(), quoted("unknown stage", "stage", ", imported as 'new'")),
        F.when(F.col("created_at") == "", "no create date; using the import date"),
    )
    source = code_key(F.col("source"))
    record = F.struct(
        *[_or_null(F.col(c)).alias(c) for c in ("first_name", "last_name", "email")],
        F.col("company"), clean_domain(F.col("domain")).alias("domain"),
        *[_or_null(F.col(c)).alias(c) for c in ("phone", "title")],
        seniority_from_title(F.col("title")).alias("seniority"),
        F.coalesce(look_up(INDUSTRY_CODES, code_key(F.col("industry"))), _or_null(F.col("industry"))).alias("industry"),
        F.coalesce(look_up(COUNTRY_CODES, code_key(F.col("country"))), _or_null(F.col("country"))).alias("country"),
        F.coalesce(_or_null(F.col("owner")), F.lit("Unassigned")).alias("owner"),
        F.coalesce(look_up(SOURCE_CODES, source), _or_null(source), F.lit("import")).alias("source"),
        F.coalesce("_stage", F.lit("new")).alias("stage"),
        F.col("_staff").alias("employees"), F.col("_deal").alias("deal_value"),
        F.when(F.col("created_at") == "", instant(as_of)).otherwise(F.col("_created")).alias("created_at"),
        F.col("_contacted").alias("last_contacted_at"),
    )
    judged = parsed.select(ROW, record.alias("record"), reasons.alias("reasons"), warnings.alias("warnings"))
    return judged.withColumn("record", F.when(F.size("reasons") == 0, F.col("record")))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("record").isNotNull()).select(ROW, "record.*")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("reasons") > 0).select(F.col(ROW).alias("row"), "reasons")


def row_warnings(rows: DataFrame) -> DataFrame:
    """One row per warning of an accepted row."""
    return (rows.filter(F.col("record").isNotNull())
            .select(F.col(ROW).alias("row"), F.posexplode("warnings").alias("place", "message")).drop("place"))


@dataclass(frozen=True)
class Preview:
    counts: DataFrame  # one row: rows, will_reject
    sample: DataFrame  # accepted records among the first five rows
    rejections: DataFrame  # first fifty


def preview(rows: DataFrame) -> Preview:
    """What an import would do; nothing is written."""
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") > 0).alias("will_reject"))
    first = rows.orderBy(ROW).limit(5)
    return Preview(counts, accepted(first), rejected(rows).orderBy("row").limit(50))


# ------------------------------------------------------------------ company resolution

@dataclass(frozen=True)
class Resolution:
    records: DataFrame  # accepted records with company_id and `company_is_new`
    new_companies: DataFrame


def _latest_event(records: DataFrame, events: DataFrame) -> DataFrame:
    """For each record the company of the last event with its name at or before its row.

    Rows are cut into buckets: inside a bucket a window looks back, and the last event of the earlier
    buckets is carried over from one small row per (name, bucket). No window holds a whole name.
    """
    bucket = F.floor(F.col(ROW) / ROWS_PER_BUCKET).alias("_bucket")
    asks = records.select(ROW, "_name", bucket)
    marks = events.select(ROW, "_name", bucket, "_event")
    ends = (asks.select("_name", "_bucket", F.lit(None).cast(f"struct<{ROW}:bigint,_event:string>").alias("_end"))
            .unionByName(marks.select("_name", "_bucket", F.struct(F.col(ROW).cast("bigint").alias(ROW), "_event").alias("_end")))
            .groupBy("_name", "_bucket").agg(F.max("_end").alias("_end")))
    past = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_name", "_bucket", F.last("_end._event", ignorenulls=True).over(past).alias("_carried"))
    timeline = (asks.withColumn("_event", F.lit(None).cast("string")).withColumn("_ask", F.lit(1))
                .unionByName(marks.withColumn("_ask", F.lit(0))))
    inside = Window.partitionBy("_name", "_bucket").orderBy(ROW, "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = timeline.withColumn("_seen", F.last("_event", ignorenulls=True).over(inside)).filter(F.col("_ask") == 1)
    return (seen.join(carried, ["_name", "_bucket"])
            .select(ROW, F.coalesce("_seen", "_carried").alias("_by_name")))


def resolve_companies(records: DataFrame, companies: DataFrame, as_of: datetime) -> Resolution:
    """Company of every record in file order: by domain, by name only where the record has no domain.

    An unknown domain or name creates a company from its first row. A company created in this batch is
    found by name by the rows after it, also in place of an existing company of that name.
    """
    known_domains = (companies.filter(F.col("domain").isNotNull() & (F.col("domain") != ""))
                     .groupBy(F.lower("domain").alias("domain")).agg(F.max("company_id").alias("_known")))
    known_names = companies.groupBy(F.lower("name").alias("_name")).agg(F.max("company_id").alias("_known"))
    named = records.withColumn("_name", F.lower("company"))
    opener = F.min(F.struct(ROW, "company", "domain", "industry", "employees", "country", "_name")).alias("_opener")

    with_domain = named.filter(F.col("domain").isNotNull())
    new_domains = (with_domain.groupBy(F.col("domain").alias("_d")).agg(opener).select("_opener.*")
                   .join(known_domains, "domain", "left_anti"))
    first_named = named.filter(F.col("domain").isNull()).groupBy(F.col("_name").alias("_n")).agg(opener).select("_opener.*")
    earliest = new_domains.groupBy("_name").agg(F.min(ROW).alias("_earliest"))
    new_names = (first_named.join(known_names, "_name", "left_anti").join(earliest, "_name", "left")
                 .filter(F.col("_earliest").isNull() | (F.col("_earliest") > F.col(ROW))).drop("_earliest"))
    created = written(with_ids(new_domains.unionByName(new_names), [ROW], "company_id", "CO", existing=companies), "new-companies")

    by_domain = known_domains.select("domain", F.col("_known").alias("_id"), F.lit(False).alias("_new")).unionByName(
        created.filter(F.col("domain").isNotNull()).select("domain", F.col("company_id").alias("_id"), F.lit(True).alias("_new")))
    found_by_domain = (with_domain.join(by_domain, "domain")
                       .select(*records.columns, F.col("_id").alias("company_id"), F.col("_new").alias("company_is_new")))
    nameless = named.filter(F.col("domain").isNull())
    events = created.select(F.col(ROW), "_name", F.col("company_id").alias("_event"))
    latest = _latest_event(nameless, events)
    found_by_name = (nameless.join(latest, ROW).join(known_names, "_name", "left")
                     .select(*records.columns, F.coalesce("_by_name", "_known").alias("company_id"),
                             F.col("_by_name").isNotNull().alias("company_is_new")))
    return Resolution(
        found_by_domain.unionByName(found_by_name),
        created.select("company_id", F.col("company").alias("name"), "domain", "industry", "employees", "country",
                       instant(as_of).alias("created_at")))


def assemble_leads(resolved: DataFrame, leads: DataFrame) -> DataFrame:
    """New leads with IDs in row order, continuing after the existing ones."""
    touched = resolved.withColumn("updated_at", F.greatest("created_at", "last_contacted_at"))
    return with_ids(touched, [ROW], "lead_id", "LD", existing=leads).select(*LEAD_COLUMNS)


# ------------------------------------------------------------------ the whole import

@dataclass(frozen=True)
class ImportResult:
    leads: DataFrame
    companies: DataFrame
    issues: DataFrame
    scores: DataFrame
    audit: DataFrame
    counts: DataFrame  # one row: imported, rejected, new_companies, matched_companies
    new_leads: DataFrame
    issue_counts: DataFrame  # issue_type, leads


def import_counts(rows: DataFrame, resolution: Resolution) -> DataFrame:
    base = rows.agg(F.count_if(F.col("record").isNotNull()).alias("imported"), F.count_if(F.size("reasons") > 0).alias("rejected"))
    matched = F.when(~F.col("company_is_new"), F.col("company_id"))
    firms = resolution.records.agg(F.count_distinct(matched).alias("matched_companies"))
    new = resolution.new_companies.agg(F.count(F.lit(1)).alias("new_companies"))
    return base.crossJoin(firms).crossJoin(new)  # one-row frames


def issue_counts(issues: DataFrame, lead_ids: DataFrame) -> DataFrame:
    """Distinct given leads per issue type, on either side of an issue; all types appear."""
    sides = issues.select("issue_type", "lead_id").unionByName(
        issues.filter(F.col("related_lead_id").isNotNull()).select("issue_type", F.col("related_lead_id").alias("lead_id")))
    hit = sides.join(lead_ids.select("lead_id"), "lead_id", "left_semi").groupBy("issue_type").agg(
        F.count_distinct("lead_id").alias("leads"))
    kinds = issues.sparkSession.createDataFrame([(k,) for k in ISSUE_TYPES], "issue_type string")
    return kinds.join(hit, "issue_type", "left").select("issue_type", F.coalesce("leads", F.lit(0)).alias("leads"))


def attachment_check(new_leads: DataFrame, old_leads: DataFrame) -> DataFrame:
    """Re-exported leads: per new lead the older leads with its e-mail, and how many of them have its company.

    Older leads are counted per (e-mail, company) first, so an address many leads share joins as a few rows.
    """
    address = F.lower(strip(F.col("email"))).alias("_email")
    old = old_leads.select(address, F.coalesce("company_id", F.lit("")).alias("_firm")).filter(F.col("_email") != "")
    per_firm = old.groupBy("_email", "_firm").agg(F.count(F.lit(1)).alias("_n"))
    total = per_firm.groupBy("_email").agg(F.sum("_n").alias("same_email"))
    new = new_leads.select("lead_id", F.coalesce("company_id", F.lit("")).alias("_firm"), address)
    return (new.join(total, "_email").join(per_firm, ["_email", "_firm"], "left")
            .select("lead_id", "same_email", F.coalesce("_n", F.lit(0)).alias("same_company")))


def import_rows(rows: DataFrame, leads: DataFrame, companies: DataFrame, activities: DataFrame, scores: DataFrame,
                audit_log: DataFrame, filename: str, actor: str, as_of: datetime, at: datetime) -> ImportResult:
    """Run an import of judged rows (`outcomes`) and refresh the derived tables.

    Duplicates can join old and new leads, so issues are detected over everything; only new leads are scored.
    """
    judged = written(rows, "import-outcomes")
    resolution = resolve_companies(accepted(judged), companies, as_of)
    new_leads = written(assemble_leads(resolution.records, leads), "new-leads")
    all_companies = companies.select(*COMPANY_COLUMNS).unionByName(resolution.new_companies)
    all_leads = leads.select(*LEAD_COLUMNS).unionByName(new_leads)
    counts = written(import_counts(judged, resolution), "import-counts")
    batches = audit_log.filter(F.col("action_id").startswith("IMP-")).agg((F.count(F.lit(1)) + 1).alias("_batch"))
    last = audit_log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    entry = counts.crossJoin(batches).crossJoin(last).select(  # one-row frames
        (F.col("_last") + 1).cast("bigint").alias("id"), F.format_string("IMP-%05d", F.col("_batch")).alias("action_id"),
        F.concat(F.lit("imported "), F.col("imported").cast("string"), F.lit(f" leads from {filename} ("),
                 F.col("rejected").cast("string"), F.lit(" rows rejected)")).alias("event"),
        instant(at).alias("at"), F.lit(actor).alias("actor"))
    issues = written(detect_issues(all_leads, all_companies, as_of), "issues")
    return ImportResult(
        all_leads, all_companies, issues, rescore(scores, all_leads, all_companies, activities, new_leads, as_of),
        audit_log.unionByName(entry), counts, new_leads, issue_counts(issues, new_leads))
