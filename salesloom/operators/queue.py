"""A whole queue of approved actions, with the result of a single writer who runs them one by one in the order of their decisions.

An action fails if a lead of it is gone: missing from the start, or given away by an earlier merge that succeeded. So only
merges depend on each other, and only over leads that an earlier one gives away. Rounds decide all merges whose earlier givers
are decided; every other action is decided at once after them. Failed actions keep the status approved, have one entry in the
audit trail and are never tried again (`changes.failed_before`).

What the actions leave behind needs no order of execution. A lead is given away once at most, so successful merges form trees.
A surviving lead's blank field is the first filled one below it, earlier merges first and within a merge by lead; it is found from
the leaves up, in as many rounds as merges lie in a row. A stage is that of the last change, or 'contacted' where an outreach
meets 'new' after it. Activities belong to the root of their lead's tree, found by doubling steps. Only leads that actions name
take part in rounds; all others are passed through.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.config import REQUIRED_FIELDS
from salesloom.functions.clock import instant
from salesloom.functions.text import blank
from salesloom.operators.changes import ACTION_COLUMNS, FAILED, append_audit, execution_summary, failed_before, field_of
from salesloom.operators.quality import refresh_issues
from salesloom.operators.scoring import rescore
from salesloom.sources.storage import written


@dataclass(frozen=True)
class Executed:
    actions: DataFrame
    audit_log: DataFrame
    leads: DataFrame
    activities: DataFrame
    issues: DataFrame
    scores: DataFrame
    outcomes: DataFrame  # action_id, state (run or gone), missing


def _turns(approved: DataFrame) -> DataFrame:
    """(action_id, turn, type, primary_id, place, lead_id, gives): a row for each lead of an action; merges give all but the primary."""
    primary = F.when(F.col("type") == "merge", field_of("primary_id"))
    rows = approved.select("action_id", F.struct("decided_at", "action_id").alias("turn"), "type", primary.alias("primary_id"), F.posexplode("lead_ids").alias("place", "lead_id"))
    return rows.withColumn("gives", (F.col("type") == "merge") & (F.col("lead_id") != F.col("primary_id")))


def _merges_done(turns: DataFrame, absent: DataFrame) -> DataFrame:
    """(lead_id, action_id, turn, primary_id): the leads that successful merges give away."""
    given = turns.filter(F.lit(False)).select("lead_id", "action_id", "turn", "primary_id")
    failed = turns.join(absent, "lead_id", "left_semi").filter("type = 'merge'").select("action_id").distinct()
    pending = written(turns.filter("type = 'merge'").join(failed, "action_id", "left_anti"), "merges")
    while not pending.isEmpty():
        first = pending.filter("gives").groupBy(F.col("lead_id").alias("of")).agg(F.min("turn").alias("first"))
        waiting = pending.join(first, F.col("lead_id") == F.col("of")).filter(F.col("first") < F.col("turn")).select("action_id").distinct()
        done = pending.join(waiting, "action_id", "left_anti").filter("gives").select("lead_id", "action_id", "turn", "primary_id")
        done = written(done, "given")
        given = given.unionAll(done)
        pending = pending.join(done.select("action_id").distinct(), "action_id", "left_anti")
        # A lead that is gone by now fails every later merge of it, whatever else that one waits for.
        lost = pending.join(done.select("lead_id", F.col("turn").alias("gone_at")), "lead_id").filter(F.col("gone_at") < F.col("turn")).select("action_id").distinct()
        pending = written(pending.join(lost, "action_id", "left_anti"), "merges")
    return given


def decide_queue(approved: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved columns, state, missing) of every action, and the given leads of `_merges_done`."""
    turns = written(_turns(approved), "turns")
    absent = turns.select("lead_id").distinct().join(leads.select("lead_id"), "lead_id", "left_anti")
    given = written(_merges_done(turns, absent), "given")
    gone_at = given.select("lead_id", F.col("turn").alias("gone_at")).unionAll(absent.select("lead_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("gone_at")))
    gone = turns.join(gone_at, "lead_id").filter(F.col("gone_at").isNull() | (F.col("gone_at") < F.col("turn"))).groupBy("action_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "lead_id"))).alias("gone"))  # leads of one action
    judged = approved.join(gone, "action_id", "left")
    state = F.when(F.col("gone").isNotNull(), "gone").otherwise("run")
    return judged.select(*approved.columns, state.alias("state"), F.array_join("gone.lead_id", ", ").alias("missing")), given


def _fill(leads: DataFrame, activities: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lead_id, fields) of the primaries after all merges, and (action_id, moved, filled) of the merges, from the leaves up."""
    named = given.select("lead_id").unionAll(given.select(F.col("primary_id").alias("lead_id"))).distinct()
    own = activities.join(named, "lead_id", "left_semi").groupBy("lead_id").agg(F.count(F.lit(1)).alias("_acts"))
    nodes = leads.select("lead_id", *REQUIRED_FIELDS).join(named, "lead_id").join(own, "lead_id", "left").fillna(0, ["_acts"])
    nodes, pending = written(nodes, "nodes"), given
    merges = None
    while not pending.isEmpty():
        open_ = pending.select("primary_id").distinct()
        blocked = pending.join(open_.withColumnRenamed("primary_id", "lead_id"), "lead_id", "left_semi").select("primary_id").distinct()
        ready = written(pending.join(blocked, "primary_id", "left_anti"), "ready")
        values = [F.min_by(F.col(f), F.when(~blank(F.col(f)), F.col("lead_id"))).alias(f) for f in REQUIRED_FIELDS]
        each = ready.join(nodes, "lead_id").groupBy("action_id", "turn", "primary_id").agg(*values, F.sum("_acts").alias("moved"))
        each = written(each.join(nodes.select(F.col("lead_id").alias("primary_id"), *[F.col(f).alias(f"_own_{f}") for f in REQUIRED_FIELDS]), "primary_id"), "merged")
        firsts = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("turn"))).alias(f"_got_{f}") for f in REQUIRED_FIELDS]
        turns = [F.min(F.when(F.col(f).isNotNull() & blank(F.col(f"_own_{f}")), F.col("turn"))).alias(f"_at_{f}") for f in REQUIRED_FIELDS]
        got = written(each.groupBy(F.col("primary_id").alias("lead_id")).agg(*firsts, *turns, F.sum("moved").alias("_more")), "filled")
        filled = F.filter(F.array(*[F.when(F.col(f"_at_{f}") == F.col("turn"), F.lit(f)) for f in REQUIRED_FIELDS]), lambda f: f.isNotNull())
        found = each.join(got.withColumnRenamed("lead_id", "primary_id"), "primary_id").select("action_id", "moved", filled.alias("filled"))
        merges = found if merges is None else merges.unionAll(found)
        taken = [F.when(blank(F.col(f)), F.coalesce(f"_got_{f}", f)).otherwise(F.col(f)).alias(f) for f in REQUIRED_FIELDS]
        nodes = written(nodes.join(got, "lead_id", "left").select("lead_id", *taken, (F.col("_acts") + F.coalesce("_more", F.lit(0))).alias("_acts")), "nodes")
        pending = written(pending.join(ready.select("primary_id").distinct(), "primary_id", "left_anti"), "open")
    if merges is None:
        merges = given.select("action_id", F.lit(0).cast("bigint").alias("moved"), F.array().cast("array<string>").alias("filled"))
    return nodes.join(given.select(F.col("primary_id").alias("lead_id")).distinct(), "lead_id", "left_semi").select("lead_id", *REQUIRED_FIELDS), merges


def roots(given: DataFrame) -> DataFrame:
    """(lead_id, primary_id): the lead that has what a given lead had, after all merges; steps double."""
    step = written(given.select("lead_id", "primary_id"), "owners")
    while True:
        over = step.select(F.col("lead_id").alias("primary_id"), F.col("primary_id").alias("_next"))
        further = written(step.join(over, "primary_id", "left").select("lead_id", F.coalesce("_next", "primary_id").alias("primary_id"), F.col("_next").isNotNull().alias("_moved")), "owners")
        step = further.select("lead_id", "primary_id")
        if further.filter("_moved").isEmpty():
            return step


def execute_queue(actions: DataFrame, audit_log: DataFrame, leads: DataFrame, companies: DataFrame, activities: DataFrame,
                  issues: DataFrame, scores: DataFrame, as_of: datetime, at: datetime) -> Executed:
    """Run all approved actions that have not failed before, and refresh issues and scores of the touched leads once."""
    approved = actions.filter(F.col("status") == "approved").join(failed_before(audit_log), "action_id", "left_anti")
    judged, given = decide_queue(approved, leads)
    judged = written(judged, "judged")
    running, now = judged.filter("state = 'run'"), instant(as_of)
    turn = F.struct("decided_at", "action_id")
    of_lead = written(running.select("type", turn.alias("turn"), field_of("stage").alias("stage"), F.explode("lead_ids").alias("lead_id")), "named")
    is_stage, is_touch = F.col("type") == "stage_change", F.col("type") == "outreach"
    changes = of_lead.groupBy("lead_id").agg(
        F.max_by(F.when(is_stage, F.col("stage")), F.when(is_stage, F.col("turn"))).alias("_stage"), F.max(F.when(is_stage, F.col("turn"))).alias("_staged"),
        F.max(F.when(is_touch, F.col("turn"))).alias("_sent"))
    values, merges = _fill(leads, activities, given)
    values = values.select("lead_id", *[F.col(f).alias(f"_{f}") for f in REQUIRED_FIELDS], F.lit(True).alias("_merged"))
    kept = leads.join(given.select("lead_id"), "lead_id", "left_anti").join(changes.withColumn("_changed", F.lit(True)), "lead_id", "left").join(values, "lead_id", "left")
    stage = F.coalesce("_stage", "stage")
    sent_after = F.col("_sent").isNotNull() & (F.col("_staged").isNull() | (F.col("_staged") < F.col("_sent")))
    new = {"stage": F.when(sent_after & (stage == "new"), "contacted").otherwise(stage),
           "last_contacted_at": F.when(F.col("_sent").isNotNull(), now).otherwise(F.col("last_contacted_at")),
           "updated_at": F.when(F.col("_changed"), now).otherwise(F.col("updated_at")),
           **{f: F.when(F.col("_merged"), F.col(f"_{f}")).otherwise(F.col(f)) for f in REQUIRED_FIELDS}}
    new_leads = written(kept.select(*[new.get(c, F.col(c)).alias(c) for c in leads.columns]), "leads")

    owners = written(roots(given), "owners")
    moved_to = F.coalesce("primary_id", "lead_id")
    new_activities = activities.join(owners, "lead_id", "left").withColumn("lead_id", moved_to).select(*activities.columns)
    touched = of_lead.select("lead_id").distinct()
    theirs = activities.join(touched, "lead_id", "left_semi").join(owners, "lead_id", "left").withColumn("lead_id", moved_to).select(*activities.columns)
    lost, related_lost = given.select("lead_id"), given.select(F.col("lead_id").alias("related_lead_id"))
    own = issues.join(lost, "lead_id", "left_anti")
    left = own.filter(F.col("related_lead_id").isNull()).unionByName(own.filter(F.col("related_lead_id").isNotNull()).join(related_lost, "related_lead_id", "left_anti").select(*own.columns))
    new_issues = refresh_issues(left.select(*issues.columns), new_leads, touched, as_of)
    new_scores = rescore(scores.join(new_leads.select("lead_id"), "lead_id", "left_semi"), new_leads, companies, theirs, touched, as_of)

    told = running.join(merges.select("action_id", F.col("moved").alias("_moved"), F.col("filled").alias("_filled")), "action_id", "left")
    entries = judged.filter("state = 'gone'").select("action_id", "decided_at", F.concat(F.lit(f"{FAILED}leads no longer exist: "), F.col("missing")).alias("event")).unionByName(
        told.select("action_id", "decided_at", F.concat(F.lit("executed: "), execution_summary()).alias("event")))
    entries = entries.select("action_id", "decided_at", "event", instant(at).alias("at"), F.lit("system").alias("actor"))
    updated = actions.join(running.select("action_id", F.lit("executed").alias("_done")), "action_id", "left").withColumn("status", F.coalesce("_done", "status")).select(*ACTION_COLUMNS)
    return Executed(updated, append_audit(audit_log, entries, ["decided_at", "action_id"]), new_leads, new_activities, new_issues, new_scores, judged.select("action_id", "state", "missing"))
