import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from salesloom.config import AS_OF
from salesloom.operators import changes, keyed
from salesloom.operators.quality import detect_issues, refresh_issues
from salesloom.operators.scoring import score_leads
from salesloom.plans import jobs
from salesloom.plans.fixture import input_view
from salesloom.plans.workspace import Workspace
from salesloom.sources import tables
from salesloom.sources.storage import written
from salesloom.sources.tables import SCHEMAS, empty_table

PROPOSALS = "proposal_id bigint, type string, lead_ids array<string>, payload_json string, actor string, note string"
DECISIONS = "action_id string, verdict string, actor string, note string, at timestamp_ntz"


def lead(n, first, last, email, phone, title, stage="new", contacted=None, created=datetime(2026, 1, 1)):
    return (f"LD-{n:05d}", "CO-00001", first, last, email, phone, title, "vp", "web", stage, 10.0, "Bo", created, contacted, created)


@pytest.fixture(scope="module")
def crm(spark):
    leads = spark.createDataFrame([
        lead(1, "Ana", "Ruiz", None, None, "CEO"), lead(2, "Ana", "Ruiz", "ana@a.com", " ", None), lead(3, "Ana", "Ruiz", "zz@a.com", "4155550134", ""),
        lead(4, "Bo", "Chen", "bo@a.com", "1", "X", "contacted", AS_OF - timedelta(days=200)), lead(5, "Cy", "Dent", "cy@a.com", "1", "X", "new", None),
        lead(6, "Di", "Eck", "di@a.com", "1", "X", "qualified", AS_OF - timedelta(days=100)), lead(7, "Ed", "Fox", "ed@a.com", "1", "X")], SCHEMAS["leads"])
    firms = spark.createDataFrame([("CO-00001", "Acme", "a.com", "Software", 10, "US", datetime(2020, 1, 1))], SCHEMAS["companies"])
    acts = spark.createDataFrame([(f"ACT-{i:05d}", f"LD-{1 + i % 7:05d}", "call", AS_OF - timedelta(days=i)) for i in range(21)], SCHEMAS["activities"])
    issues = detect_issues(leads, firms, AS_OF)
    return leads, firms, acts, issues, score_leads(leads, firms, acts, AS_OF)


def propose(spark, rows):
    data = [(i, t, ids, json.dumps(p), "alice", None) for i, (t, ids, p) in enumerate(rows)]
    return spark.createDataFrame(data, PROPOSALS)


@pytest.mark.parametrize("kind, ids, payload, error", [
    ("stage_change", ["LD-00001"], {"stage": "bogus"}, "payload.stage must be one of"),
    ("merge", ["LD-00001"], {}, "merge needs at least two lead_ids"),
    ("merge", ["LD-00001", "LD-00002"], {"primary_id": "LD-00003"}, "payload.primary_id must be one of lead_ids"),
    ("outreach", ["LD-00001"], {"subject": "", "body": "x"}, "outreach needs payload.subject and payload.body"),
    ("stage_change", ["LD-99999", "LD-00001", "LD-88888"], {"stage": "won"}, "unknown lead_ids: LD-99999, LD-88888"),
    ("stage_change", [], {"stage": "won"}, "at least one lead_id is required"),
    ("stage_change", ["LD-00001", "LD-00001"], {"stage": "won"}, "lead_ids must be unique"),
])
def test_invalid_proposals(spark, crm, kind, ids, payload, error):
    row = changes.check_proposals(propose(spark, [(kind, ids, payload)]), crm[0]).first()
    assert row.error.startswith(error)


def run(spark, crm, proposals, decisions):
    leads, firms, acts, issues, scores = crm
    checked = changes.check_proposals(propose(spark, proposals), leads)
    made = changes.create_actions(checked, empty_table(spark, "actions"), empty_table(spark, "audit_log"), AS_OF)
    at = datetime(2026, 9, 16)
    rows = [(f"AX-{n:05d}", v, who, note, at + timedelta(minutes=i)) for i, (n, v, who, note) in enumerate(decisions)]
    decided = changes.decide(made.actions, spark.createDataFrame(rows, DECISIONS), made.audit_log)
    return decided, changes.execute(decided.actions, decided.audit_log, leads, firms, acts, issues, scores, AS_OF, at)


def test_decisions_and_execution(spark, crm):
    leads, firms, acts, issues, scores = crm
    decided, done = run(spark, crm, [
        ("merge", ["LD-00001", "LD-00003", "LD-00002"], {"primary_id": "LD-00001"}), ("outreach", ["LD-00005", "LD-00004"], {"subject": " Hi ", "body": "b"}),
        ("stage_change", ["LD-00006"], {"stage": "lost"}), ("stage_change", ["LD-00007"], {"stage": "won"}), ("stage_change", ["LD-00002"], {"stage": "qualified"}),
    ], [(1, "approved", "bob", "confirmed"), (2, "approved", "bob", None), (3, "approved", "bob", None), (4, "rejected", "carol", "not yet"),
        (4, "approved", "bob", None), (5, "approved", "bob", None)])
    assert [(r.action_id, r.message) for r in decided.conflicts.collect()] == [("AX-00004", "AX-00004 is already rejected")]
    actions = {r.action_id: r for r in done.actions.collect()}
    assert [actions[f"AX-0000{i}"].status for i in range(1, 6)] == ["executed", "executed", "executed", "rejected", "approved"]
    assert json.loads(actions["AX-00002"].payload_json) == {"subject": "Hi", "body": "b", "channel": "email", "citations": []}
    assert [r.action_id for r in done.deferred.collect()] == ["AX-00005"]
    after = {r.lead_id: r for r in done.leads.collect()}
    assert set(after) == {f"LD-0000{i}" for i in (1, 4, 5, 6, 7)}
    assert (after["LD-00001"].email, after["LD-00001"].phone, after["LD-00001"].title, after["LD-00001"].updated_at) == ("ana@a.com", "4155550134", "CEO", AS_OF)
    assert (after["LD-00005"].stage, after["LD-00004"].stage, after["LD-00006"].stage, after["LD-00007"].stage) == ("contacted", "contacted", "lost", "new")
    assert after["LD-00004"].last_contacted_at == AS_OF
    moved = {r.lead_id: r["count"] for r in done.activities.groupBy("lead_id").count().collect()}
    assert moved == {"LD-00001": 9, **{f"LD-0000{i}": 3 for i in (4, 5, 6, 7)}}
    # Incremental refresh equals a full rebuild, apart from the issue numbers.
    fields = ["lead_id", "issue_type", "details", "related_lead_id"]
    full = {tuple(r) for r in detect_issues(done.leads, firms, AS_OF).select(*fields).collect()}
    assert {tuple(r) for r in done.issues.select(*fields).collect()} == full
    assert done.issues.select("issue_id").distinct().count() == done.issues.count()
    want = {tuple(r) for r in score_leads(done.leads, firms, done.activities, AS_OF).collect()}
    assert {tuple(r) for r in done.scores.collect()} == want
    assert {r.lead_id: r.recency for r in done.scores.collect()}["LD-00004"] == 2.0 and {r.lead_id: r.recency for r in done.scores.collect()}["LD-00006"] == 0.0
    trail = {r.action_id: [e.event for e in r.audit] for r in changes.list_actions(done.actions, done.audit_log).collect()}
    assert trail["AX-00001"] == ["created merge for LD-00001, LD-00003, LD-00002", "approved: confirmed",
                                 "executed: merged LD-00003, LD-00002 into LD-00001 (moved 6 activities, filled email, phone)"]
    assert trail["AX-00002"][-1] == "executed: logged email outreach to LD-00005, LD-00004"
    assert trail["AX-00003"][-1] == "executed: set stage to 'lost' on LD-00006" and trail["AX-00004"][-1] == "rejected: not yet"
    ids = [r.id for r in done.audit_log.orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    # The deferred action meets a lead that is gone.
    later = changes.execute(done.actions, done.audit_log, done.leads, firms, done.activities, done.issues, done.scores, AS_OF, AS_OF)
    last = later.audit_log.orderBy(F.desc("id")).first()
    assert (last.action_id, last.event, last.actor) == ("AX-00005", "execution failed: leads no longer exist: LD-00002", "system")
    assert {r.action_id: r.status for r in later.actions.collect()}["AX-00005"] == "approved"
    assert {tuple(r) for r in later.leads.collect()} == {tuple(r) for r in done.leads.collect()}


def test_lists_and_counts(spark, crm):
    decided, done = run(spark, crm, [("stage_change", ["LD-00006", "LD-00007"], {"stage": "lost"}), ("stage_change", ["LD-00005"], {"stage": "won"})],
                        [(2, "rejected", "carol", None)])
    pending = changes.list_actions(done.actions, done.audit_log, status="pending").collect()
    assert [(r.action_id, len(r.audit)) for r in pending] == [("AX-00001", 1)]
    assert [r.action_id for r in changes.list_actions(done.actions, done.audit_log, lead_id="LD-00007").collect()] == ["AX-00001"]
    assert [r.action_id for r in changes.list_actions(done.actions, done.audit_log).collect()] == ["AX-00002", "AX-00001"]
    assert {r.status: r.n for r in changes.action_counts(done.actions).collect()} == {"pending": 1, "rejected": 1, "all": 2}


def test_refresh_adds_no_duplicates(spark, crm):
    leads, firms, _, issues, _ = crm
    edited = leads.withColumn("email", F.when(F.col("lead_id").isin("LD-00004", "LD-00005"), "same@a.com").otherwise(F.col("email")))
    touched = edited.filter(F.col("lead_id").isin("LD-00004", "LD-00005")).select("lead_id")
    got = refresh_issues(issues, edited, touched, AS_OF)
    assert got.filter("issue_type = 'duplicate'").count() == issues.filter("issue_type = 'duplicate'").count()
    assert min(int(r.issue_id[4:]) for r in got.join(issues, "issue_id", "left_anti").collect() or [type("R", (), {"issue_id": "ISS-99999"})]) > 0


def test_keyed_changes_and_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (4, "d")], "k int, v string")
    assert {tuple(r) for r in keyed.upsert(df, new, "k").collect()} == {(1, "a"), (2, "B"), (3, None), (4, "d")}
    assert {r.k for r in keyed.delete_keys(df, new.select("k"), "k").collect()} == {1, 3}
    assert {tuple(r) for r in keyed.update_keys(df, new, "k", {"v": F.upper("v")}).collect()} == {(1, "a"), (2, "B"), (3, None)}
    assert keyed.with_default_column(df, "n", F.lit(0)).columns == ["k", "v", "n"] and keyed.with_default_column(df, "v", F.lit("")) is df
    broken = {r.violation: r["rows"] for r in keyed.violations(df.union(df.limit(1)), ["k"], ["v"]).collect()}
    assert broken == {"v is null": 1, "k not unique": 1}
    with pytest.raises(ValueError):
        keyed.require_constraints(df, ["k"], ["v"])
    assert keyed.require_constraints(df, ["k"]) is df


def test_table_versions_appends_and_snapshots(spark, crm, tmp_path):
    leads, _, acts, _, scores = crm
    root = str(tmp_path / "scores")
    tables.replace_rows(scores, root)
    tables.replace_rows(scores.limit(2), root)
    assert tables.read_latest(spark, root, SCHEMAS["lead_scores"]).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_latest(spark, str(tmp_path / "none"))
    for _ in range(2):
        tables.append_activities(acts, str(tmp_path / "acts"))
    assert spark.read.parquet(str(tmp_path / "acts")).count() == 42
    tables.append_rows(leads, str(tmp_path / "leads"))
    assert spark.read.schema(SCHEMAS["leads"]).parquet(str(tmp_path / "leads")).count() == 7
    tables.write_json(leads, str(tmp_path / "json"))
    back = tables.read_json(spark, str(tmp_path / "json"), SCHEMAS["leads"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in leads.collect()}
    (tmp_path / "q.jsonl").write_text('{"id":"Q1","kind":"scalar","question":"q","expected":3}\n{"id":"Q2","kind":"id_set","question":"q","expected":["LD-1"]}\n')
    rows = tables.read_questions(spark, str(tmp_path / "q.jsonl")).select("id", F.to_json("expected").alias("e")).orderBy("id").collect()
    assert [(r.id, r.e) for r in rows] == [("Q1", "3"), ("Q2", '["LD-1"]')]


# ------------------------------------------------------------------ a whole queue

def single_writer(leads, acts, approved):
    """Leads, owners of activities and events after the actions one by one."""
    now, owner, events = {r["lead_id"]: r.asDict() for r in leads}, {a: l for a, l in acts}, []
    for action, kind, ids, payload in approved:
        gone = [i for i in ids if i not in now]
        if gone:
            events.append((action, "execution failed: leads no longer exist: " + ", ".join(gone)))
            continue
        for i in ids:
            now[i]["updated_at"] = AS_OF
            if kind == "stage_change":
                now[i]["stage"] = payload["stage"]
            if kind == "outreach":
                now[i]["last_contacted_at"] = AS_OF
                now[i]["stage"] = "contacted" if now[i]["stage"] == "new" else now[i]["stage"]
        if kind == "stage_change":
            events.append((action, f"executed: set stage to '{payload['stage']}' on {', '.join(ids)}"))
        elif kind == "outreach":
            events.append((action, f"executed: logged email outreach to {', '.join(ids)}"))
        else:
            primary = payload["primary_id"]
            others = [i for i in ids if i != primary]
            filled = []
            for f in ("email", "phone", "title"):
                given = [now[i][f] for i in sorted(others) if (now[i][f] or "").strip()]
                if given and not (now[primary][f] or "").strip():
                    now[primary][f] = given[0]
                    filled.append(f)
            moved = [a for a, l in owner.items() if l in others]
            owner.update(dict.fromkeys(moved, primary))
            for i in others:
                del now[i]
            extra = f", filled {', '.join(filled)}" if filled else ""
            events.append((action, f"executed: merged {', '.join(others)} into {primary} (moved {len(moved)} activities{extra})"))
    return now, owner, events


def queue_of(spark, leads, acts, approved, status="approved", log=None):
    from salesloom.operators import queue
    firms = spark.createDataFrame([("CO-00001", "Acme", "a.com", "Software", 10, "US", datetime(2020, 1, 1))], SCHEMAS["companies"])
    rows = [(a, k, ids, json.dumps(p), status, AS_OF, AS_OF + timedelta(minutes=n), "bo", None) for n, (a, k, ids, p) in enumerate(approved)]
    actions = spark.createDataFrame(rows, SCHEMAS["actions"])
    return queue.execute_queue(actions, empty_table(spark, "audit_log") if log is None else log, leads, firms, acts, detect_issues(leads, firms, AS_OF),
                               score_leads(leads, firms, acts, AS_OF), AS_OF, AS_OF)


@pytest.mark.parametrize("seed", [1])
def test_a_queue_is_a_single_writer(spark, seed):
    import random
    rng = random.Random(seed)
    ids = [f"LD-{n:05d}" for n in range(1, 26)]
    leads = spark.createDataFrame([lead(n, "A", "B", rng.choice([None, " ", f"m{n}@a.com"]), rng.choice([None, f"p{n}"]), rng.choice(["", f"t{n}"]), rng.choice(["new", "won"])) for n in range(1, 26)], SCHEMAS["leads"])
    acts = spark.createDataFrame([(f"ACT-{i:05d}", rng.choice(ids), "call", AS_OF - timedelta(days=i)) for i in range(60)], SCHEMAS["activities"])
    approved = []
    for n in range(45):
        some = rng.sample(ids + ["LD-99999"], rng.randint(2, 3)) if rng.random() < 0.9 else ["LD-00001", rng.choice(ids[1:])]
        kind = rng.choice(["merge", "merge", "stage_change", "outreach"])
        payload = {"merge": {"primary_id": some[0]}, "stage_change": {"stage": rng.choice(["new", "proposal"])}, "outreach": {"subject": "s", "body": "b", "channel": "email"}}[kind]
        approved.append((f"AX-{rng.randrange(10**4):04d}{n:02d}", kind, some, payload))
    got = queue_of(spark, leads, acts, approved)
    now, owner, events = single_writer(leads.collect(), [(r.activity_id, r.lead_id) for r in acts.collect()], approved)
    assert [(r.action_id, r.event) for r in got.audit_log.orderBy("id").collect()] == events
    assert {r.lead_id: r.asDict() for r in got.leads.collect()} == now
    assert {r.activity_id: r.lead_id for r in got.activities.collect()} == owner
    full = {(r.lead_id, r.score) for r in score_leads(got.leads, spark.createDataFrame([("CO-00001", "Acme", "a.com", "Software", 10, "US", datetime(2020, 1, 1))], SCHEMAS["companies"]), got.activities, AS_OF).collect()}
    assert {(r.lead_id, r.score) for r in got.scores.collect()} == full
    assert {r.status for r in got.actions.collect()} == {"approved", "executed"}
    again = queue_of(spark, got.leads, got.activities, approved, "approved", got.audit_log.filter(F.col("event").startswith("execution failed")))
    failed = {a for a, e in events if e.startswith("execution failed")}
    assert failed and not failed & {r.action_id for r in again.outcomes.collect()}  # tried once


def test_a_failed_action_does_not_hold_up_a_batch(spark, crm):
    """The first action on a lead merges it with a deleted one; the next batch goes on with the second action."""
    leads, firms, acts, issues, scores = crm
    made = changes.create_actions(changes.check_proposals(propose(spark, [("merge", ["LD-00001", "LD-00002"], {"primary_id": "LD-00001"}), ("stage_change", ["LD-00001"], {"stage": "won"})]), leads),
                                  empty_table(spark, "actions"), empty_table(spark, "audit_log"), AS_OF)
    decisions = spark.createDataFrame([(f"AX-0000{n}", "approved", "bo", None, AS_OF + timedelta(minutes=n)) for n in (1, 2)], DECISIONS)
    state = changes.decide(made.actions, decisions, made.audit_log)
    left, actions, log = leads.filter("lead_id <> 'LD-00002'"), state.actions, state.audit_log
    seen = []
    for _ in range(3):
        done = changes.execute(actions, log, left, firms, acts, issues, scores, AS_OF, AS_OF)
        actions, log, left = done.actions, done.audit_log, done.leads
        seen.append(([r.status for r in actions.orderBy("action_id").collect()], log.filter(F.col("event").startswith("execution failed")).count()))
    assert seen == [(["approved", "approved"], 1), (["approved", "executed"], 1), (["approved", "executed"], 1)]


def test_an_empty_queue(spark, crm):
    got = queue_of(spark, crm[0], crm[2], [])
    assert got.leads.count() == crm[0].count() and got.audit_log.count() == 0


def test_proposals_and_decisions_of_one_small_file_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "ROWS_PER_TASK", 20)
    keys = [*range(90), 7, 7, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    ws = Workspace(spark, str(tmp_path))
    for name, made in (("proposals", jobs.proposals(ws).withColumn("lead_list", F.array_join("lead_ids", ","))), ("decisions", jobs.decisions(ws))):
        whole = input_view(spark, str(tmp_path), name)
        found = written(made.select(*whole.columns), name)
        assert found.select(F.input_file_name()).distinct().count() >= 4  # 5 asked for, as many as the session's tasks
        assert found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()
