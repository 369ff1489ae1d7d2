"""Registered jobs of the other operators over the given tables: import, changes, evidence, reuse, evaluation, events."""

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.config import HEADER_SPELLINGS
from salesloom.functions.text import fold, normalize_email
from salesloom.operators import calendar, changes, dedup_index, evaluate, evidence, fingerprint, importing, keyed, limiter, notes, quality, queue, scoring
from salesloom.operators.ordering import store_order, stored_page
from salesloom.plans.dashboard import health_counts, issue_order, issue_rows, lead_detail, overview_totals, resolve_ids
from salesloom.plans.fixture import given_table, input_view
from salesloom.plans.workspace import Workspace
from salesloom.sources import csv_files, ledger, tables
from salesloom.sources.csv_files import ROW
from salesloom.sources.storage import scratch_path, written
from salesloom.streaming import jobs as streams

MAPPING = {target: target for target in HEADER_SPELLINGS}
AT = datetime(2024, 1, 26, 9, 0, 0)
ROWS_PER_TASK = 25_000


# ------------------------------------------------------------------ import

def export_rows(ws: Workspace, rows_per_task: int | None = None) -> DataFrame:
    return input_view(ws.spark, ws.sf_dir, "export_rows", rows_per_task).withColumnRenamed("row_no", ROW)


def judged(ws: Workspace) -> DataFrame:
    # A row takes 0.1 ms to parse and its key 8 bytes to read, so splits of the file are far too large for this.
    return ws.once("judged", lambda: written(importing.outcomes(export_rows(ws, ROWS_PER_TASK), MAPPING, ws.as_of), "judged"))


def import_outcomes(ws: Workspace) -> DataFrame:
    return judged(ws).select(F.col(ROW).alias("row"), F.col("record").isNotNull().alias("accepted"),
                             F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"))


def import_records(ws: Workspace) -> DataFrame:
    return importing.accepted(judged(ws)).withColumnRenamed(ROW, "row")


def import_preview(ws: Workspace) -> DataFrame:
    p = importing.preview(judged(ws))
    return p.rejections.crossJoin(p.counts).select("row", F.array_join("reasons", "; ").alias("reasons"), "rows", "will_reject")  # one row of counts


def resolution(ws: Workspace) -> importing.Resolution:
    return ws.once("resolution", lambda: importing.resolve_companies(importing.accepted(judged(ws)), ws.companies, ws.as_of))


def import_companies(ws: Workspace) -> DataFrame:
    return resolution(ws).records.select(F.col(ROW).alias("row"), "company_id", "company_is_new")


def imported(ws: Workspace) -> importing.ImportResult:
    return ws.once("imported", lambda: importing.import_rows(
        judged(ws), ws.leads, ws.companies, ws.activities, ws.lead_scores, tables.empty_table(ws.spark, "audit_log"),
        "export.csv", "tester", ws.as_of, AT))


def import_csv_files(ws: Workspace) -> DataFrame:
    """The export written as CSV files and scanned again, outcomes counted by reason."""
    def build() -> DataFrame:
        path = scratch_path(ws.spark, "export")
        csv_files.write_csv(export_rows(ws).drop(ROW), path)
        return written(csv_files.scan_csv(ws.spark, f"{path}/*.csv", max_bytes=None, max_rows=None).rows, "scanned")
    rows = ws.once("csv-scan", build)
    out = importing.outcomes(rows, MAPPING, ws.as_of)
    return (out.select(F.explode_outer("reasons").alias("reason")).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("rows")))


def import_mixed_exports(ws: Workspace) -> DataFrame:
    """Two exports, one in UTF-8 and one in Latin-1 with its columns the other way round, scanned as one."""
    def build() -> DataFrame:
        path = scratch_path(ws.spark, "exports")
        rows = export_rows(ws)
        columns = [c for c in rows.columns if c != ROW]
        csv_files.write_csv(rows.filter(F.col(ROW) % 2 == 0).select(*columns), f"{path}/utf8")
        csv_files.write_csv(rows.filter(F.col(ROW) % 2 == 1).select(*columns[::-1]), f"{path}/latin1", "ISO-8859-1")
        return written(csv_files.scan_csv(ws.spark, f"{path}/*/*.csv").rows.select(*columns), "mixed")
    return ws.once("mixed-exports", build)


def import_csv_documents(ws: Workspace) -> DataFrame:
    """Whole documents as CSV cells, scanned in small splits, so that cells with line breaks go over their ends."""
    def build() -> DataFrame:
        spark, name = ws.spark, "spark.sql.files.maxPartitionBytes"
        path, before = scratch_path(spark, "documents"), spark.conf.get(name)
        csv_files.write_csv(given_table(spark, ws.sf_dir, "documents").select("doc_id", "source", "text"), path)
        spark.conf.set(name, "256k")
        try:
            rows = csv_files.scan_csv(spark, f"{path}/*.csv").rows
            return written(rows.select("doc_id", "source", F.length("text").alias("n_chars"), F.md5("text").alias("digest")), "documents-scanned")
        finally:
            spark.conf.set(name, before)
    return ws.once("csv-documents", build)


def reexported_leads(ws: Workspace) -> DataFrame:
    """The copies in the lead view against all other leads: do they sit at the company of their original?"""
    is_copy = (F.substring("lead_id", 4, 20).cast("bigint") - 1) % 25 == 24
    return importing.attachment_check(ws.leads.filter(is_copy), ws.leads.filter(~is_copy))


# ------------------------------------------------------------------ changes

def proposals(ws: Workspace) -> DataFrame:
    # Texts are made and checked by as many tasks as they need, as in the import.
    return input_view(ws.spark, ws.sf_dir, "proposals", ROWS_PER_TASK).withColumn("lead_ids", F.split("lead_list", ",")).drop("lead_list")


def decisions(ws: Workspace) -> DataFrame:
    return input_view(ws.spark, ws.sf_dir, "decisions", ROWS_PER_TASK)


def checked(ws: Workspace) -> DataFrame:
    return ws.once("checked", lambda: written(changes.check_proposals(written(proposals(ws), "proposals"), ws.leads), "checked"))


def created(ws: Workspace) -> changes.Change:
    return ws.once("created", lambda: changes.create_actions(
        checked(ws), tables.empty_table(ws.spark, "actions"), tables.empty_table(ws.spark, "audit_log"), ws.as_of))


def decided(ws: Workspace) -> changes.Decided:
    return ws.once("decided", lambda: changes.decide(
        created(ws).actions, written(decisions(ws), "decisions"), created(ws).audit_log))


def remaining(ws: Workspace) -> DataFrame:
    """The leads that are left when the batch runs: some were deleted after the decisions."""
    return ws.leads.filter(F.substring("lead_id", 4, 20).cast("bigint") % 97 != 5)


def executed(ws: Workspace) -> changes.Executed:
    return ws.once("executed", lambda: changes.execute(
        decided(ws).actions, decided(ws).audit_log, remaining(ws), ws.companies, ws.activities, ws.data_issues, ws.lead_scores, ws.as_of, AT))


def queued(ws: Workspace) -> queue.Executed:
    """The same decisions as `executed`, run to the end: every action in the order of a single writer."""
    return ws.once("queued", lambda: queue.execute_queue(
        decided(ws).actions, decided(ws).audit_log, remaining(ws), ws.companies, ws.activities, ws.data_issues, ws.lead_scores, ws.as_of, AT))


def action_rows(df: DataFrame) -> DataFrame:
    return df.select("action_id", "type", F.array_join("lead_ids", ",").alias("lead_ids"), "payload_json", "status", "decided_at", "decided_by", "note")


def audit_trail(ws: Workspace) -> DataFrame:
    run = executed(ws)
    return changes.list_actions(run.actions, run.audit_log).select(
        "action_id", "status", F.array_join(F.transform("audit", lambda e: F.concat(e["actor"], F.lit("="), e["event"])), " | ").alias("trail"))


def batch_plan(ws: Workspace) -> DataFrame:
    approved = decided(ws).actions.filter(F.col("status") == "approved")
    return changes.plan_batch(approved, remaining(ws)).select("action_id", "state", "missing")


# ------------------------------------------------------------------ evidence

def lead_notes(ws: Workspace) -> DataFrame:
    return notes.why_now(ws.leads, ws.companies, ws.activities, ws.as_of)


def perturbed_notes(ws: Workspace) -> DataFrame:
    """The notes, some with a wrong ID, a wrong number, an invented reference, or no reference at all."""
    n = F.substring("lead_id", 4, 20).cast("bigint")
    text = (F.when(n % 10 == 5, F.concat(F.col("note"), F.lit(" See [LD-00000].")))
            .when(n % 10 == 6, F.concat(F.col("note"), F.lit(" Worth 123456.7 today.")))
            .when(n % 10 == 7, F.concat(F.col("note"), F.lit(" See [the table].")))
            .when(n % 10 == 8, F.lit("A very good lead."))
            .otherwise(F.col("note")))
    return lead_notes(ws).select(F.col("lead_id").alias("answer_id"), text.alias("text"), F.lit(None).cast("string").alias("question"))


def note_audit(ws: Workspace) -> DataFrame:
    # Texts and evidence are stored data for the audit, which reads both several times.
    rows = ws.once("note-evidence", lambda: written(
        notes.note_evidence(ws.leads, ws.companies, ws.activities, ws.lead_scores, ws.as_of), "evidence"))
    texts = ws.once("note-texts", lambda: written(perturbed_notes(ws), "texts"))
    verdicts = evidence.audit_texts(texts, rows)
    return verdicts.select("answer_id", "valid", F.array_join("unknown_ids", ",").alias("unknown_ids"),
                           F.array_join("unsupported_numbers", ",").alias("unsupported_numbers"), "reason")


def _cut_number(x, decimals: int):
    """A number cut, not rounded, to one decimal or none, so that about half of the texts state what no cell rounds to."""
    units = F.floor(x * 10 ** decimals).cast("bigint")
    return units.cast("string") if not decimals else F.concat((F.floor(units / 10)).cast("bigint").cast("string"), F.lit("."), F.pmod(units, F.lit(10)).cast("string"))


def number_audit(ws: Workspace) -> DataFrame:
    """Texts that state deal value, score, share, day and row count of a lead, checked against its row."""
    share = (F.col("fit") / F.greatest("score", F.lit(1.0))).alias("share")
    rows = ws.leads.filter("deal_value IS NOT NULL").join(ws.lead_scores, "lead_id").select("lead_id", "deal_value", "score", "fit", "intent", share)
    ev = rows.select(F.col("lead_id").alias("answer_id"), F.lit(0).cast("bigint").alias("row_no"), evidence.to_cells(rows).alias("cells"))
    third = F.col("score") / 3
    text = F.concat(F.lit("Deal of "), _cut_number(F.col("deal_value") + F.col("fit") / 40, 0), F.lit(", score "), _cut_number(F.col("score"), 1), F.lit(" as of 2024-01-26, fit is "),
                    _cut_number(F.col("share") * 100, 1), F.lit("% of it, a third "), _cut_number(third, 1), F.lit(" in 1 row ["), F.col("lead_id"), F.lit("]."))
    texts = rows.select(F.col("lead_id").alias("answer_id"), text.alias("text"), F.lit(None).cast("string").alias("question"))
    verdicts = evidence.audit_texts(written(texts, "texts"), written(ev, "evidence"))
    return verdicts.select("answer_id", "valid", F.array_join("unsupported_numbers", " ").alias("unsupported_numbers"))


def industry_summaries(ws: Workspace) -> DataFrame:
    """One answer per industry: its companies as result rows, summarized."""
    rows = ws.companies.filter(F.col("industry").isNotNull())
    cells = evidence.to_cells(rows, ["company_id", "name", "employees"])
    number = F.substring("company_id", 4, 20).cast("bigint")
    ev = rows.select(F.col("industry").alias("answer_id"), number.alias("row_no"), cells.alias("cells"))
    answers = ev.select("answer_id").distinct()
    return evidence.summarize_rows(answers, ev)


def cited_row_tables(ws: Workspace) -> DataFrame:
    """All IDs the notes cite, resolved to their source rows."""
    ids = lead_notes(ws).select(F.explode(evidence.ids_in(F.col("note"))).alias("id"))
    return resolve_ids(ws, ids).select("id", "table", F.get_json_object("row", "$.lead_id").alias("lead_id"))


# ------------------------------------------------------------------ scores in detail

def score_contributions(ws: Workspace) -> DataFrame:
    return scoring.contributions(ws.leads, ws.companies, ws.activities, ws.as_of)


def score_breakdowns(ws: Workspace) -> DataFrame:
    b = scoring.breakdowns(ws.leads, ws.companies, ws.activities, ws.as_of)
    parts = [F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in scoring.COMPONENTS for f in ("points", "summary")]
    strongest = F.array_join(F.col("intent.contributions.ref"), ",").alias("intent_refs")
    return b.select("lead_id", "score", *parts, strongest)


def score_citations(ws: Workspace) -> DataFrame:
    return scoring.cited_rows(score_contributions(ws))


# ------------------------------------------------------------------ result reuse

READS = {0: ["companies"], 1: ["leads", "lead_scores"], 2: ["activities"], 3: ["data_issues", "companies"], 4: []}


def stored_results(ws: Workspace) -> DataFrame:
    """One stored result per benchmark text; which tables it read follows from the item number."""
    reads = F.lit(None)
    for remainder, names in READS.items():
        reads = F.when(F.col("item_id") % 5 == remainder, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(reads)
    items = given_table(ws.spark, ws.sf_dir, "benchmark")
    kind = F.when(F.col("item_id") % 2 == 0, "ask").otherwise("explain")
    return items.select(kind.alias("kind"), fingerprint.result_key(kind, F.col("text"), F.lit("v1")).alias("key"),
                        F.to_json(F.struct("item_id")).alias("payload"), reads.alias("tables"))


def queryable(ws: Workspace) -> dict[str, DataFrame]:
    return {name: getattr(ws, name) for name in tables.QUERYABLE_TABLES}


def table_checksums(ws: Workspace) -> DataFrame:
    """Row counts and checksums of the five tables, in a form that SQL can check; the fingerprints of results are internal."""
    columns = {name: [part.split()[0] for part in schema.split(", ")] for name, schema in tables.SCHEMAS.items()}
    parts = [fingerprint.portable_checksum(df.select(*columns[name]), name) for name, df in queryable(ws).items()]
    return reduce(DataFrame.unionByName, parts)


def kept_parts(ws: Workspace) -> DataFrame:
    """Fingerprint parts of the queryable tables, from one full pass."""
    return ws.once("parts", lambda: written(reduce(DataFrame.unionByName, [fingerprint.fingerprint_parts(df, name) for name, df in queryable(ws).items()]), "parts"))


def valid_results(ws: Workspace) -> DataFrame:
    """Stored results that are still valid after one lead changed its stage; no table is scanned again."""
    entries = fingerprint.store_results(stored_results(ws), fingerprint.as_fingerprints(kept_parts(ws)))
    first = ws.leads.join(ws.leads.agg(F.min("lead_id").alias("lead_id")), "lead_id", "left_semi").select(*ws.leads.columns)
    moved = first.withColumn("stage", F.lit("negotiation"))
    after = fingerprint.advance(kept_parts(ws), fingerprint.keyed_delta(ws.leads, moved, "lead_id", "leads"))
    return fingerprint.valid_entries(entries, fingerprint.as_fingerprints(after)).select("kind", "key", "payload")


def kept_fingerprints(ws: Workspace) -> DataFrame:
    """Kept parts after the deletion of leads and a whole queue of changes with merges, from the changed rows alone, and whether a
    full pass over the tables finds the same."""
    run = queued(ws)
    deleted = ws.leads.filter(F.substring("lead_id", 4, 20).cast("bigint") % 97 == 5)
    named = run.outcomes.filter("state = 'run'").select("action_id").join(decided(ws).actions, "action_id").select(F.explode("lead_ids").alias("lead_id")).distinct()
    out = deleted.unionByName(remaining(ws).join(named, "lead_id", "left_semi").select(*ws.leads.columns))
    into = run.leads.join(named, "lead_id", "left_semi").select(*ws.leads.columns)
    given = named.join(run.leads.select("lead_id"), "lead_id", "left_anti")
    left = ws.activities.join(given, "lead_id", "left_semi").select(*ws.activities.columns)
    moved = run.activities.join(left.select("activity_id"), "activity_id", "left_semi").select(*ws.activities.columns)
    after = written(fingerprint.advance(kept_parts(ws), fingerprint.delta(out, into, "leads"), fingerprint.delta(left, moved, "activities")), "advanced")
    wrong = fingerprint.verify(after, {**queryable(ws), "leads": run.leads, "activities": run.activities}).withColumn("_wrong", F.lit(True))
    return after.join(wrong, "table", "left").select("table", F.col("n").alias("rows"), F.col("_wrong").isNull().alias("same"))


def exported_results(ws: Workspace) -> DataFrame:
    """Valid results written as JSON lines and loaded again against the same tables."""
    def build() -> DataFrame:
        now = written(fingerprint.snapshot(queryable(ws)), "fingerprints")
        path = scratch_path(ws.spark, "entries")
        fingerprint.export_entries(fingerprint.store_results(stored_results(ws), now), now, path)
        return fingerprint.load_entries(ws.spark, path, now)
    return ws.once("exported", build).select("kind", "key", "payload")


# ------------------------------------------------------------------ duplicates over batches

def batched_duplicates(ws: Workspace) -> DataFrame:
    """Duplicates after a start with a quarter of the leads and three batches: new leads, wrong addresses put right, others deleted."""
    def build() -> DataFrame:
        view, root = quality.matching_view(ws.leads, ws.companies), scratch_path(ws.spark, "duplicates")
        view = written(view.withColumn("_n", F.substring("lead_id", 4, 20).cast("bigint")), "view")
        leads, nobody = view.drop("_n"), ws.leads.select("lead_id").limit(0)

        def part(n: int) -> DataFrame:
            return view.filter(F.col("_n") % 4 == n).drop("_n")
        wrong = part(0).withColumn("email", F.lit("desk@shared.example")).withColumn("last_name", F.lower(F.reverse("last_name")))
        extra = part(1).withColumn("lead_id", F.concat(F.lit("XX-"), F.col("lead_id")))
        dedup_index.build(wrong, root)
        dedup_index.apply_batch(ws.spark, root, part(1).unionByName(extra), nobody)
        dedup_index.apply_batch(ws.spark, root, part(2).unionByName(part(0)), nobody)
        dedup_index.apply_batch(ws.spark, root, part(3), extra.select("lead_id").unionByName(leads.select("lead_id").limit(0)))
        return dedup_index.duplicates(ws.spark, root)
    return ws.once("batched-duplicates", build)


# ------------------------------------------------------------------ the clock

def advanced(ws: Workspace) -> DataFrame:
    """Scores and stale records nine days ago, moved on to as_of in three steps."""
    def build() -> DataFrame:
        root, before = scratch_path(ws.spark, "calendar"), ws.as_of - timedelta(days=9)
        calendar.start(ws.leads, ws.companies, ws.activities, before, root)
        for step, days in enumerate((8, 3, 0), 1):
            now = ws.as_of - timedelta(days=days)
            calendar.advance(ws.spark, ws.leads, ws.companies, ws.activities, before, now, root, step)
            before = now
        return written(calendar.current(ws.spark, root, ws.leads), "advanced")
    return ws.once("advanced", build)


# ------------------------------------------------------------------ tables, pages and files

def issue_page_stored(ws: Workspace) -> DataFrame:
    """Three pages of the stored issue order: the first, one in the middle and the last, with the number of all issues."""
    def build() -> str:
        return store_order(issue_rows(ws), issue_order(), scratch_path(ws.spark, "issue-order"), rows_per_file=250)
    path = ws.once("issue-order", build)
    total = stored_page(ws.spark, path, 1, 20)[1]
    pages = [1, max(1, total // 40), max(1, -(-total // 20))]
    return reduce(DataFrame.unionByName, [stored_page(ws.spark, path, p, 20)[0].withColumn("page", F.lit(p)).withColumn("total", F.lit(total)) for p in dict.fromkeys(pages)])


def lead_detail_rows(ws: Workspace) -> DataFrame:
    """The page of one lead, the one with the most activities: what is on it, by part."""
    first = ws.activities.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lead_id").first()["lead_id"]
    parts = lead_detail(ws, first)
    rows = [parts["lead"].select(F.lit("lead").alias("part"), F.col("lead_id").alias("id"), F.col("score").cast("string").alias("value")),
            parts["activities"].select(F.lit("activity"), "activity_id", "type"), parts["issues"].select(F.lit("issue"), "issue_id", "details")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def since_half(ws: Workspace) -> DataFrame:
    """The ledger's files, from the middle of its time on."""
    def build() -> str:
        folder = scratch_path(ws.spark, "ledger-files")
        ledger.append_ledger(ledger_entries(ws), folder)
        return folder
    return ledger.read_ledger(ws.spark, ws.once("ledger-files", build), since="2024-01-16T12")


def latest_companies(ws: Workspace) -> DataFrame:
    """A table that was refreshed once, read at its newest version with a column that it does not have yet."""
    def build() -> str:
        root = scratch_path(ws.spark, "companies-table")
        tables.replace_rows(ws.companies, root)
        tables.replace_rows(ws.companies.filter("employees > 100").withColumn("industry", F.upper("industry")), root)
        return root
    return tables.read_latest(ws.spark, ws.once("companies-table", build), tables.SCHEMAS["companies"] + ", region string")


def appended_activities(ws: Workspace) -> DataFrame:
    """Activities appended in two parts, counted by their day folders."""
    def build() -> str:
        path = scratch_path(ws.spark, "activities-table")
        for rest in (0, 1):
            tables.append_activities(ws.activities.filter(F.pmod(F.crc32("activity_id"), F.lit(2)) == rest), path)
        return path
    stored = ws.spark.read.parquet(ws.once("activities-table", build))
    return stored.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("activities"), F.count_distinct("lead_id").alias("leads"))


def file_limits(ws: Workspace) -> DataFrame:
    """Whether the export is refused under limits that its rows pass or do not pass."""
    def build() -> tuple[str, int]:
        path, rows = scratch_path(ws.spark, "limited"), export_rows(ws).drop(ROW)
        csv_files.write_csv(rows.coalesce(1), path)  # limits hold for each file
        return path, rows.count()
    path, count = ws.once("limited-export", build)

    def refused(**limits) -> bool:
        try:
            csv_files.scan_csv(ws.spark, f"{path}/*.csv", **limits)
            return False
        except csv_files.ImportRejected:
            return True
    found = [("rows as many", refused(max_rows=count)), ("one row less", refused(max_rows=count - 1)), ("few bytes", refused(max_bytes=count))]
    return ws.spark.createDataFrame([(name, count, no) for name, no in found], "limit string, rows bigint, refused boolean")


# ------------------------------------------------------------------ evaluation

def truth_rows(ws: Workspace) -> DataFrame:
    """The answer key of the lead view: its copies, its stale leads, its blank fields."""
    copies = input_view(ws.spark, ws.sf_dir, "truth").select(F.lit("duplicate").alias("issue_type"), "a", "b")
    late = ws.leads.filter(~F.col("stage").isin("won", "lost") & (F.coalesce("last_contacted_at", "created_at") < F.lit("2023-10-01").cast("timestamp_ntz")))
    stale = late.select(F.lit("stale").alias("issue_type"), F.col("lead_id").alias("a"), F.lit("").alias("b"))
    blank = ws.leads.filter("email IS NULL OR trim(email) = ''").select(
        F.lit("missing_field").alias("issue_type"), F.col("lead_id").alias("a"), F.lit("email").alias("b"))
    return copies.unionByName(stale).unionByName(blank)


def found_pairs(ws: Workspace) -> DataFrame:
    return ws.data_issues.filter(F.col("issue_type") == "duplicate").select(*evaluate.pair_key("lead_id", "related_lead_id"))


def unseeded_pairs(ws: Workspace) -> DataFrame:
    """Found pairs outside the truth when copies of one kind count as traps."""
    truth = input_view(ws.spark, ws.sf_dir, "truth")
    return evaluate.false_positives(found_pairs(ws), truth.filter("kind <> 'kind 3'"), truth.filter("kind = 'kind 3'"))


def results(ws: Workspace) -> DataFrame:
    return input_view(ws.spark, ws.sf_dir, "results")


def graded_counts(ws: Workspace) -> DataFrame:
    """Answers of three runs over event counts, graded: one run is off by one for some users."""
    events = given_table(ws.spark, ws.sf_dir, "events").select(F.format_string("Q%05d", "user_id").alias("question_id"), "user_id", "event_type")
    counted = events.groupBy("question_id", "user_id", F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    runs = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run_id")
    asked = counted.select("question_id", "user_id").distinct().select(
        "question_id", runs, F.when(F.col("user_id") % 20 == 19, "decline").otherwise("table").alias("kind"),
        (F.col("user_id") % 40 != 39).alias("answered"))
    off = F.when((F.col("user_id") % 3 == F.col("run_id")) & (F.col("key") == "error"), 1.0).otherwise(0.0)
    got = counted.select("*", runs).select("question_id", "run_id", "key", (F.col("value") + off).alias("value"))
    return evaluate.grade(got, counted.select("question_id", F.upper("key").alias("key"), "value"), asked)


def answer_rows(ws: Workspace) -> DataFrame:
    """Answers of all three kinds built from lead rows, one question per owner."""
    rows = ws.leads.join(ws.lead_scores, "lead_id").withColumn("row_no", F.substring("lead_id", 4, 20).cast("bigint"))
    cells = evidence.to_cells(rows, ["lead_id", "stage", "score"])
    kind = F.explode(F.array(F.lit("scalar"), F.lit("id_set"), F.lit("table"))).alias("kind")
    table_cells = F.when(F.col("kind") == "table", F.filter("cells", lambda c: c["name"] != "lead_id")).otherwise(F.col("cells"))
    shaped = rows.select(F.col("owner").alias("question_id"), F.lit(0).alias("run_id"), "row_no", cells.alias("cells"), kind).withColumn("cells", table_cells)
    return evaluate.answer_table(shaped).drop("run_id")


# ------------------------------------------------------------------ events, ledger, streams

def event_hits(ws: Workspace) -> DataFrame:
    return given_table(ws.spark, ws.sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("t"), F.col("event_id").alias("hit_id"))


DAY = 86_400


def limit_flags(ws: Workspace) -> DataFrame:
    return limiter.limit_flags(event_hits(ws), 3, DAY).select("key", "hit_id", "admitted", F.round("wait_seconds", 3).alias("wait_seconds"))


def ledger_entries(ws: Workspace) -> DataFrame:
    return input_view(ws.spark, ws.sf_dir, "ledger")


def _event_stream(ws: Workspace) -> DataFrame:
    schema = given_table(ws.spark, ws.sf_dir, "events").schema
    return streams.stream_folder(ws.spark, ws.sf_dir, schema, pattern="events.parquet")


def _drained(ws: Workspace, name: str, df: DataFrame) -> DataFrame:
    path = scratch_path(ws.spark, name)
    streams.drain(df, path, scratch_path(ws.spark, f"{name}-checkpoint"))
    return ws.spark.read.schema(df.schema).parquet(path)


def stream_limit_flags(ws: Workspace) -> DataFrame:
    def build() -> DataFrame:
        hits = _event_stream(ws).select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("t"), F.col("event_id").alias("hit_id"))
        root = scratch_path(ws.spark, "flags")
        streams.run_refresh(hits, streams.limiter(root, 3, DAY), scratch_path(ws.spark, "flags-checkpoint"))
        return streams.current_flags(ws.spark, root)
    return ws.once("stream-flags", build).select("key", "hit_id", "admitted", F.round("wait_seconds", 3).alias("wait_seconds"))


def _activity_stream(ws: Workspace) -> DataFrame:
    """The activities view as a stream over the events file."""
    from salesloom.plans.fixture import ACTIVITIES_SQL
    return ws.spark.sql(ACTIVITIES_SQL.replace("FROM events", "FROM {events}"), events=_event_stream(ws))


def stream_intent(ws: Workspace) -> DataFrame:
    """Points per lead and type from the events the stream kept."""
    kept = ws.once("stream-intent", lambda: _drained(ws, "intent", streams.intent_events(_activity_stream(ws), ws.as_of, "40 days")))
    recent = scoring.recent_activities(kept, ws.as_of)
    return recent.groupBy("lead_id").agg(F.sum(F.round(F.col("points") * 100).cast("bigint")).alias("cents"))


def stream_scores(ws: Workspace) -> DataFrame:
    """Scores of all leads with activity, kept by micro-batches."""
    def build() -> DataFrame:
        root = scratch_path(ws.spark, "refreshed")
        streams.run_refresh(_activity_stream(ws), streams.refresher(root, ws.leads, ws.companies, ws.as_of), scratch_path(ws.spark, "refresh-checkpoint"))
        return streams.current_scores(ws.spark, root)
    return ws.once("stream-scores", build)


def stream_ledger(ws: Workspace) -> DataFrame:
    """Daily totals per purpose from the ledger's files."""
    def build() -> DataFrame:
        folder = scratch_path(ws.spark, "ledger")
        ledger.append_ledger(ledger_entries(ws), folder)
        totals = streams.ledger_windows(streams.ledger_stream(ws.spark, folder), "1 day")
        path, seen = scratch_path(ws.spark, "ledger-totals"), scratch_path(ws.spark, "ledger-checkpoint")

        def save(batch: DataFrame, number: int) -> None:  # changed windows of one micro-batch
            batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

        query = (totals.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", seen).trigger(availableNow=True).start())
        query.awaitTermination()
        changed = ws.spark.read.parquet(path)
        newest = changed.groupBy("start", "purpose").agg(F.max_by(F.struct("tokens", "calls", "failed"), "batch").alias("v"))
        return newest.select("start", "purpose", "v.*")
    return ws.once("stream-ledger", build).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "purpose", "tokens", "calls", "failed")


# ------------------------------------------------------------------ keyed changes, constraints, text

def closed_leads_reopened(ws: Workspace) -> DataFrame:
    """Upsert: the lost leads replace themselves as new leads."""
    lost = ws.leads.filter(F.col("stage") == "lost").withColumn("stage", F.lit("new"))
    return keyed.upsert(ws.leads, lost, "lead_id").select("lead_id", "stage")


def leads_without_issues(ws: Workspace) -> DataFrame:
    """Delete by key set: the leads left when every lead with an issue is removed."""
    return keyed.delete_keys(ws.leads, ws.data_issues.select("lead_id").distinct(), "lead_id").select("lead_id", "owner")


def constraint_violations(ws: Workspace) -> DataFrame:
    """Constraint audit of given tables: repeated keys and missing values."""
    lines = given_table(ws.spark, ws.sf_dir, "lineitem")
    docs = given_table(ws.spark, ws.sf_dir, "labels")
    first = keyed.violations(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).withColumn("table", F.lit("lineitem"))
    second = keyed.violations(docs, ["doc_id"], ["quality", "toxic"]).withColumn("table", F.lit("labels"))
    third = keyed.violations(ws.leads, ["lead_id"], ["email", "company_id"]).withColumn("table", F.lit("leads"))
    return first.unionByName(second).unionByName(third)


def issue_refresh(ws: Workspace) -> DataFrame:
    """Issues after every lead of one owner was contacted and another owner's leads were deleted."""
    now = F.lit(ws.as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    edited = ws.leads.filter(F.col("owner") != "Yara Moss").withColumn(
        "last_contacted_at", F.when(F.col("owner") == "Karl Lindt", now).otherwise(F.col("last_contacted_at")))
    touched = ws.leads.filter(F.col("owner").isin("Karl Lindt", "Yara Moss")).select("lead_id")
    return quality.refresh_issues(ws.data_issues, edited, touched, ws.as_of).select("lead_id", "issue_type", "details", "related_lead_id")


def document_emails(ws: Workspace) -> DataFrame:
    """E-mail addresses in the whole texts, normalized."""
    docs = given_table(ws.spark, ws.sf_dir, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]*[A-Za-z0-9]"), F.lit(0))).alias("e"))
    return docs.groupBy(normalize_email(F.col("e")).alias("email")).agg(F.count(F.lit(1)).alias("n"))


def document_folds(ws: Workspace) -> DataFrame:
    """Folded whole texts, by their digest."""
    docs = given_table(ws.spark, ws.sf_dir, "documents")
    return docs.select("doc_id", F.md5(fold(F.col("text"))).alias("digest"))


JOBS = {
    "import_outcomes": import_outcomes,
    "import_records": import_records,
    "import_preview": import_preview,
    "import_companies": import_companies,
    "import_new_companies": lambda ws: resolution(ws).new_companies,
    "import_counts": lambda ws: imported(ws).counts,
    "import_leads": lambda ws: imported(ws).new_leads,
    "import_issue_counts": lambda ws: imported(ws).issue_counts,
    "import_audit": lambda ws: imported(ws).audit,
    "import_csv_files": import_csv_files,
    "import_csv_documents": import_csv_documents,
    "reexported_leads": reexported_leads,
    "overview_with_actions": lambda ws: overview_totals(ws, executed(ws).actions),
    "health_counts": lambda ws: health_counts(ws, stored_results(ws)),
    "proposal_checks": lambda ws: checked(ws).select("proposal_id", "type", "error"),
    "created_actions": lambda ws: action_rows(created(ws).actions).select("action_id", "type", "lead_ids", "payload_json", "status", "note"),
    "decided_actions": lambda ws: action_rows(decided(ws).actions).select("action_id", "status", "decided_at", "decided_by", "note"),
    "decision_conflicts": lambda ws: decided(ws).conflicts,
    "batch_plan": batch_plan,
    "executed_leads": lambda ws: executed(ws).leads,
    "executed_activities": lambda ws: executed(ws).activities,
    "executed_issues": lambda ws: executed(ws).issues.select("lead_id", "issue_type", "details", "related_lead_id"),
    "executed_scores": lambda ws: executed(ws).scores,
    "executed_audit": audit_trail,
    "queue_outcomes": lambda ws: queued(ws).outcomes,
    "queue_leads": lambda ws: queued(ws).leads,
    "queue_activities": lambda ws: queued(ws).activities,
    "queue_failures": lambda ws: queued(ws).audit_log.filter(F.col("event").startswith(changes.FAILED)).select("action_id", "event"),
    "action_counts": lambda ws: changes.action_counts(executed(ws).actions),
    "issue_refresh": issue_refresh,
    "why_now_notes": lambda ws: lead_notes(ws).select("lead_id", "note", F.array_join("refs", ",").alias("refs")),
    "outreach_drafts": lambda ws: notes.outreach_drafts(ws.leads, ws.companies, ws.activities, ws.as_of).select(
        "lead_id", "subject", "body", F.array_join("citations", ",").alias("citations")),
    "note_audit": note_audit,
    "number_audit": number_audit,
    "industry_summaries": industry_summaries,
    "cited_row_tables": cited_row_tables,
    "score_contributions": score_contributions,
    "score_breakdowns": score_breakdowns,
    "score_citations": score_citations,
    "table_fingerprints": table_checksums,
    "import_mixed_exports": import_mixed_exports,
    "valid_results": valid_results,
    "kept_fingerprints": kept_fingerprints,
    "batched_duplicates": batched_duplicates,
    "advanced_scores": lambda ws: advanced(ws).select("lead_id", "score", "fit", "intent", "recency"),
    "advanced_stale": lambda ws: advanced(ws).filter("stale IS NOT NULL").select("lead_id", F.col("stale").alias("details")),
    "issue_page_stored": issue_page_stored,
    "lead_detail": lead_detail_rows,
    "ledger_since": lambda ws: ledger.ledger_totals(since_half(ws)),
    "latest_companies": latest_companies,
    "appended_activities": appended_activities,
    "rejected_actions": lambda ws: changes.list_actions(decided(ws).actions, decided(ws).audit_log, status="rejected").select(
        "action_id", "decided_by", F.size("audit").alias("entries")),
    "file_limits": file_limits,
    "exported_results": exported_results,
    "cleaning_metrics": lambda ws: evaluate.cleaning_metrics(ws.data_issues, truth_rows(ws)),
    "recall_by_kind": lambda ws: evaluate.recall_by_kind(found_pairs(ws), input_view(ws.spark, ws.sf_dir, "truth")),
    "unseeded_pairs": unseeded_pairs,
    "trap_hits": lambda ws: evaluate.trap_hits(found_pairs(ws), input_view(ws.spark, ws.sf_dir, "truth").filter("kind <> 'kind 1'")),
    "answer_table": answer_rows,
    "graded_answers": graded_counts,
    "run_summary": lambda ws: evaluate.run_summary(results(ws)),
    "passed_by_category": lambda ws: evaluate.passed_by(results(ws), "category"),
    "passed_by_source": lambda ws: evaluate.passed_by(results(ws), "source"),
    "run_spread": lambda ws: evaluate.run_spread(evaluate.run_summary(results(ws))),
    "question_stability": lambda ws: evaluate.question_stability(results(ws)),
    "ledger_totals": lambda ws: ledger.ledger_totals(ledger_entries(ws)),
    "ledger_by_purpose": lambda ws: ledger.ledger_by_purpose(ledger_entries(ws)),
    "ledger_errors": lambda ws: ledger.ledger_errors(ledger_entries(ws)),
    "limit_flags": limit_flags,
    "stream_limit_flags": stream_limit_flags,
    "stream_intent": stream_intent,
    "stream_scores": stream_scores,
    "stream_ledger": stream_ledger,
    "upsert_reopened": closed_leads_reopened,
    "delete_flagged": leads_without_issues,
    "constraint_violations": constraint_violations,
    "document_emails": document_emails,
    "document_folds": document_folds,
}
