"""Reviewed changes: proposals, decisions, execution and the audit trail, as batches.

One batch runs at most one action per lead, the one decided first. Later actions on a lead wait for
the next batch, which gives the order of a single writer without taking actions one by one. An action that failed
stays approved, as its audit entry says, and takes part in no further batch. `queue.execute_queue` runs all that wait at once.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.config import ALL_STAGES, REQUIRED_FIELDS
from salesloom.functions.clock import instant
from salesloom.functions.text import blank, strip
from salesloom.operators.ordering import number_rows, with_ids
from salesloom.operators.quality import refresh_issues
from salesloom.operators.scoring import rescore
from salesloom.sources.storage import written

ACTION_COLUMNS = ["action_id", "type", "lead_ids", "payload_json", "status", "created_at", "decided_at", "decided_by", "note"]
AUDIT_COLUMNS = ["id", "action_id", "event", "at", "actor"]


def field_of(name: str) -> Column:
    return F.get_json_object("payload_json", f"$.{name}")


def _lead_list() -> Column:
    return F.array_join("lead_ids", ", ")


# ------------------------------------------------------------------ proposals

def check_proposals(proposals: DataFrame, leads: DataFrame) -> DataFrame:
    """Add `error` (the first rule a proposal breaks, or NULL) and the cleaned `payload_json`.

    `proposals(proposal_id, type, lead_ids, payload_json, ...)`.
    """
    wanted = proposals.select("proposal_id", F.posexplode("lead_ids").alias("place", "lead_id"))
    gone = wanted.join(leads.select("lead_id"), "lead_id", "left_anti").groupBy("proposal_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "lead_id"))).alias("_gone"))  # bounded by one proposal's list
    primary = F.coalesce(field_of("primary_id"), F.get("lead_ids", F.lit(0)))
    subject, body = strip(F.coalesce(field_of("subject"), F.lit(""))), strip(F.coalesce(field_of("body"), F.lit("")))
    stage = F.coalesce(field_of("stage"), F.lit(""))
    kind = F.col("type")
    error = (
        F.when(F.size("lead_ids") < 1, "at least one lead_id is required")
        .when(F.size(F.array_distinct("lead_ids")) != F.size("lead_ids"), "lead_ids must be unique")
        .when((kind == "stage_change") & ~stage.isin(*ALL_STAGES), f"payload.stage must be one of {list(ALL_STAGES)}")
        .when((kind == "merge") & (F.size("lead_ids") < 2), "merge needs at least two lead_ids")
        .when((kind == "merge") & ~F.array_contains("lead_ids", primary), "payload.primary_id must be one of lead_ids")
        .when((kind == "outreach") & ((subject == "") | (body == "")), "outreach needs payload.subject and payload.body")
        .when(F.col("_gone").isNotNull(), F.concat(F.lit("unknown lead_ids: "), F.array_join("_gone.lead_id", ", ")))
    )
    cited = F.coalesce(F.from_json(field_of("citations"), "array<string>"), F.array().cast("array<string>"))
    clean = (
        F.when(kind == "stage_change", F.to_json(F.struct(stage.alias("stage"))))
        .when(kind == "merge", F.to_json(F.struct(primary.alias("primary_id"))))
        .otherwise(F.to_json(F.struct(subject.alias("subject"), body.alias("body"),
                                      F.coalesce(field_of("channel"), F.lit("email")).alias("channel"), cited.alias("citations"))))
    )
    return (proposals.join(gone, "proposal_id", "left").withColumn("error", error)
            .withColumn("payload_json", F.when(F.col("error").isNull(), clean).otherwise(F.col("payload_json"))).drop("_gone"))


@dataclass(frozen=True)
class Change:
    actions: DataFrame
    audit_log: DataFrame


def append_audit(audit_log: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """The log with `entries(action_id, event, at, actor, ...)` behind it, ids going on without gaps."""
    last = audit_log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = number_rows(entries, order, "_n").crossJoin(F.broadcast(last))  # one row
    return audit_log.select(*AUDIT_COLUMNS).unionByName(
        numbered.select((F.col("_n") + F.col("_last")).alias("id"), "action_id", "event", "at", "actor"))


def create_actions(checked: DataFrame, actions: DataFrame, audit_log: DataFrame, at: datetime) -> Change:
    """Valid proposals become pending actions in the order of `proposal_id`; `actor` and `note` come from the proposal."""
    valid = checked.filter(F.col("error").isNull())
    new = written(with_ids(valid, ["proposal_id"], "action_id", "AX", existing=actions), "actions")
    rows = new.select("action_id", "type", "lead_ids", "payload_json", F.lit("pending").alias("status"),
                      instant(at).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("decided_at"),
                      F.lit(None).cast("string").alias("decided_by"), "note")
    event = F.concat(F.lit("created "), F.col("type"), F.lit(" for "), _lead_list())
    entries = new.select("action_id", event.alias("event"), instant(at).alias("at"), "actor")
    return Change(actions.unionByName(rows), append_audit(audit_log, entries, ["action_id"]))


# ------------------------------------------------------------------ decisions

@dataclass(frozen=True)
class Decided:
    actions: DataFrame
    audit_log: DataFrame
    conflicts: DataFrame  # action_id, at, actor, message


def decide(actions: DataFrame, decisions: DataFrame, audit_log: DataFrame) -> Decided:
    """Apply `decisions(action_id, verdict, actor, note, at)`, verdict approved or rejected.

    Only a pending action can be decided and the first decision by time counts; the others are conflicts.
    """
    made = F.struct("at", "actor", "verdict", "note")
    first = decisions.groupBy("action_id").agg(F.min(made).alias("_first"))
    known = actions.select("action_id", F.col("status").alias("_was"))
    judged = decisions.join(first, "action_id").join(known, "action_id")
    wins = (F.col("_was") == "pending") & made.eqNullSafe(F.col("_first"))
    accepted = judged.filter(wins).dropDuplicates(["action_id"]).select(
        "action_id", "verdict", F.col("at").alias("_at"), F.col("actor").alias("_actor"), F.col("note").alias("_note"))
    joined = actions.join(accepted, "action_id", "left")
    updated = joined.select(
        "action_id", "type", "lead_ids", "payload_json", F.coalesce("verdict", "status").alias("status"), "created_at",
        F.coalesce("_at", "decided_at").alias("decided_at"), F.coalesce("_actor", "decided_by").alias("decided_by"),
        F.coalesce("_note", "note").alias("note"))
    text = F.concat(F.col("verdict"), F.when(F.coalesce("_note", F.lit("")) != "", F.concat(F.lit(": "), F.col("_note"))).otherwise(""))
    entries = accepted.select("action_id", text.alias("event"), F.col("_at").alias("at"), F.col("_actor").alias("actor"))
    state = F.when(F.col("_was") == "pending", F.col("_first.verdict")).otherwise(F.col("_was"))
    conflicts = judged.filter(~wins).select("action_id", "at", "actor", F.concat(
        F.col("action_id"), F.lit(" is already "), state).alias("message"))
    return Decided(updated, append_audit(audit_log, entries, ["at", "action_id"]), conflicts)


# ------------------------------------------------------------------ execution

@dataclass(frozen=True)
class Executed:
    actions: DataFrame
    audit_log: DataFrame
    leads: DataFrame
    activities: DataFrame
    issues: DataFrame
    scores: DataFrame
    deferred: DataFrame  # action_id of the actions left for the next batch


FAILED = "execution failed: "


def failed_before(audit_log: DataFrame) -> DataFrame:
    """(action_id) of the actions that were tried and failed."""
    return audit_log.filter(F.col("event").startswith(FAILED)).select("action_id").distinct()


def plan_batch(approved: DataFrame, leads: DataFrame) -> DataFrame:
    """Approved actions with `state`: run, gone (with the missing leads) or wait."""
    pairs = approved.select("action_id", F.struct("decided_at", "action_id").alias("turn"), F.posexplode("lead_ids").alias("place", "lead_id"))
    first = pairs.groupBy("lead_id").agg(F.min("turn").alias("_first"))
    blocked = (pairs.join(first, "lead_id").filter(F.col("_first") < F.col("turn")).select("action_id").distinct()
               .withColumn("_blocked", F.lit(True)))
    gone = pairs.join(leads.select("lead_id"), "lead_id", "left_anti").groupBy("action_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "lead_id"))).alias("_gone"))
    state = F.when(F.col("_blocked"), "wait").when(F.col("_gone").isNotNull(), "gone").otherwise("run")
    return (approved.join(blocked, "action_id", "left").join(gone, "action_id", "left")
            .select(*approved.columns, state.alias("state"), F.array_join("_gone.lead_id", ", ").alias("missing")))


def _merges(running: DataFrame) -> DataFrame:
    """Donor lead to primary lead, one row per donor."""
    merge = running.filter(F.col("type") == "merge").select("action_id", "lead_ids", field_of("primary_id").alias("primary_id"))
    return (merge.select("action_id", "primary_id", F.explode("lead_ids").alias("lead_id"))
            .filter(F.col("lead_id") != F.col("primary_id")))


def _survivors(leads: DataFrame, donors: DataFrame) -> DataFrame:
    """Per merge the value each blank field of the primary can take: the first non-blank donor by lead ID."""
    given = leads.join(donors, "lead_id")
    best = [F.min_by(F.col(f), F.when(~blank(F.col(f)), F.col("lead_id"))).alias(f"_{f}") for f in REQUIRED_FIELDS]
    return given.groupBy(F.col("primary_id").alias("lead_id"), "action_id").agg(*best)


def execute(actions: DataFrame, audit_log: DataFrame, leads: DataFrame, companies: DataFrame, activities: DataFrame,
            issues: DataFrame, scores: DataFrame, as_of: datetime, at: datetime) -> Executed:
    """Run one batch of the approved actions and refresh issues and scores of the touched leads."""
    approved = actions.filter(F.col("status") == "approved").join(failed_before(audit_log), "action_id", "left_anti")
    plan = written(plan_batch(approved, leads), "batch")
    running = plan.filter(F.col("state") == "run")
    now = instant(as_of)
    donors = written(_merges(running), "donors")
    survivors = written(_survivors(leads, donors), "survivors")
    stage_set = running.filter(F.col("type") == "stage_change").select(F.explode("lead_ids").alias("lead_id"), field_of("stage").alias("_stage"))
    contacted = running.filter(F.col("type") == "outreach").select(F.explode("lead_ids").alias("lead_id"), F.lit(True).alias("_sent"))
    kept = leads.join(donors, "lead_id", "left_anti")
    joined = (kept.join(stage_set, "lead_id", "left").join(contacted, "lead_id", "left")
              .join(survivors.withColumn("_merged", F.lit(True)), "lead_id", "left"))
    sent = F.coalesce("_sent", F.lit(False))
    changes = {
        "stage": F.coalesce("_stage", F.when(sent & (F.col("stage") == "new"), F.lit("contacted")).otherwise(F.col("stage"))),
        "last_contacted_at": F.when(sent, now).otherwise(F.col("last_contacted_at")),
        "updated_at": F.when(F.col("_stage").isNotNull() | sent | F.col("_merged"), now).otherwise(F.col("updated_at")),
        **{f: F.when(blank(F.col(f)), F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in REQUIRED_FIELDS},
    }
    new_leads = written(joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in leads.columns]), "leads")
    moves = donors.select("lead_id", "primary_id", F.col("action_id").alias("_action"))
    # Activities are not rewritten: a table with a row for each donor says whose they are now, and readers apply it.
    new_activities = (activities.join(moves.select("lead_id", "primary_id"), "lead_id", "left")
                      .withColumn("lead_id", F.coalesce("primary_id", "lead_id")).select(*activities.columns))
    moved = activities.select("lead_id").join(moves, "lead_id").groupBy(F.col("_action").alias("action_id")).agg(F.count(F.lit(1)).alias("_moved"))

    gone = donors.select("lead_id")
    related_gone = gone.withColumnRenamed("lead_id", "related_lead_id")
    own = issues.join(gone, "lead_id", "left_anti")
    left_issues = own.filter(F.col("related_lead_id").isNull()).unionByName(
        own.filter(F.col("related_lead_id").isNotNull()).join(related_gone, "related_lead_id", "left_anti").select(*own.columns))
    touched = running.select(F.explode("lead_ids").alias("lead_id"))
    # Only activities of the touched leads, donors among them, are read for the new scores.
    theirs = activities.join(touched.distinct(), "lead_id", "left_semi").join(moves.select("lead_id", "primary_id"), "lead_id", "left")
    theirs = theirs.withColumn("lead_id", F.coalesce("primary_id", "lead_id")).select(*activities.columns)
    new_issues = refresh_issues(left_issues.select(*issues.columns), new_leads, touched, as_of)
    new_scores = rescore(scores.join(new_leads.select("lead_id"), "lead_id", "left_semi"), new_leads, companies, theirs, touched, as_of)

    entries = plan.filter(F.col("state") == "gone").select(
        "action_id", F.concat(F.lit(f"{FAILED}leads no longer exist: "), F.col("missing")).alias("event")).unionByName(
        running.join(moved, "action_id", "left").join(_filled(leads, survivors), "action_id", "left")
        .select("action_id", F.concat(F.lit("executed: "), execution_summary()).alias("event")))
    entries = entries.select("action_id", "event", instant(at).alias("at"), F.lit("system").alias("actor"))
    done = running.select("action_id").withColumn("_done", F.lit("executed"))
    updated = actions.join(done, "action_id", "left").withColumn("status", F.coalesce("_done", "status")).select(*ACTION_COLUMNS)
    return Executed(updated, append_audit(audit_log, entries, ["action_id"]), new_leads, new_activities, new_issues, new_scores,
                    plan.filter(F.col("state") == "wait").select("action_id"))


def _filled(leads: DataFrame, survivors: DataFrame) -> DataFrame:
    """Names of the fields each merge filled in."""
    primary = leads.select("lead_id", *REQUIRED_FIELDS).join(survivors, "lead_id")
    taken = F.filter(F.array(*[F.when(blank(F.col(f)) & F.col(f"_{f}").isNotNull(), F.lit(f)) for f in REQUIRED_FIELDS]),
                     lambda f: f.isNotNull())
    return primary.select("action_id", taken.alias("_filled"))


def execution_summary() -> Column:
    primary = field_of("primary_id")
    others = F.array_join(F.filter("lead_ids", lambda i: i != primary), ", ")
    extra = F.when(F.size(F.coalesce("_filled", F.array().cast("array<string>"))) > 0,
                   F.concat(F.lit(", filled "), F.array_join("_filled", ", "))).otherwise("")
    return (
        F.when(F.col("type") == "stage_change", F.concat(F.lit("set stage to '"), field_of("stage"), F.lit("' on "), _lead_list()))
        .when(F.col("type") == "outreach", F.concat(F.lit("logged "), F.coalesce(field_of("channel"), F.lit("email")),
                                                    F.lit(" outreach to "), _lead_list()))
        .otherwise(F.concat(F.lit("merged "), others, F.lit(" into "), primary, F.lit(" (moved "),
                            F.coalesce("_moved", F.lit(0)).cast("string"), F.lit(" activities"), extra, F.lit(")")))
    )


# ------------------------------------------------------------------ lists

def list_actions(actions: DataFrame, audit_log: DataFrame, status: str | None = None, lead_id: str | None = None) -> DataFrame:
    """Actions newest first, each with its own audit entries in order."""
    df = actions
    if status:
        df = df.filter(F.col("status") == status)
    if lead_id:
        df = df.filter(F.array_contains("lead_ids", lead_id))
    entry = F.struct("id", "event", "at", "actor")
    trail = (audit_log.join(df.select("action_id"), "action_id", "left_semi").groupBy("action_id")
             .agg(F.array_sort(F.collect_list(entry)).alias("audit")))  # a few entries per action
    return df.join(trail, "action_id", "left").orderBy(F.desc("created_at"), F.desc("action_id"))


def action_counts(actions: DataFrame) -> DataFrame:
    """Actions per status and, under `all`, in total."""
    return (actions.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("_all"))
            .select(F.when(F.col("_all") == 1, "all").otherwise(F.col("status")).alias("status"), "n"))
