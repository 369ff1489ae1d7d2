import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.operators.limiter import limit_flags, walk
from salesloom.operators.quality import missing_issues, stale_issues
from salesloom.operators.scoring import intent_totals, score_leads
from salesloom.plans.workspace import Workspace
from salesloom.sources.ledger import ledger_by_purpose, ledger_errors, ledger_totals, read_ledger
from salesloom.streaming import jobs


def sequential(rows, limit, window=60_000_000):
    out, state = {}, {}
    for key, t, hit in sorted(rows, key=lambda r: (r[1], r[2])):
        recent = state.setdefault(key, [])
        recent[:] = [h for h in recent if t - h < timedelta(microseconds=window)]
        out[hit] = len(recent) < limit
        if out[hit]:
            recent.append(t)
    return out


def hits(n=3000, seed=3):
    rng, start = random.Random(seed), datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}"
        rows.append((key, start + timedelta(seconds=rng.randint(0, 4000), microseconds=rng.choice([0, 0, 500_000])), i))
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_walk_equals_a_count_of_passed_hits(seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(rng.choice([80, 2000])) for _ in range(150))
    limit, window, cut = rng.randint(1, 6), rng.randint(1, 50), rng.randrange(150)
    passed, want = [], []
    for t in times:
        inside = [x for x in passed if t - x < window]
        want.append(-1 if len(inside) < limit else inside[-limit] + window - t)
        if want[-1] < 0:
            passed.append(t)
    first, state = walk(np.array(times[:cut], np.int64), np.empty(0, np.int64), limit, window)
    second, _ = walk(np.array(times[cut:], np.int64), state, limit, window)
    assert [*first, *second] == want


def test_a_very_busy_key(spark):
    n = 1_000_000  # 1,000 hits a second for 1,000 seconds
    df = spark.range(n).select(F.lit("busy").alias("key"), F.timestamp_micros(F.col("id") * 1000).alias("t"), F.col("id").alias("hit_id"))
    got = limit_flags(df, 50, 60).groupBy("admitted").count().collect()
    assert {r.admitted: r["count"] for r in got} == {True: 17 * 50, False: n - 17 * 50}


@pytest.mark.parametrize("rounds", [1, 12])
def test_a_hot_key_in_chunks_has_the_same_flags(spark, rounds):
    """Hits at random, every second, and in bursts; few rounds leave pieces that are walked as a whole."""
    rng, start = random.Random(9), datetime(2026, 1, 1)
    rows = [("dense", start + timedelta(seconds=rng.random() * 3000), i) for i in range(2500)]
    rows += [("even", start + timedelta(seconds=i), 10_000 + i) for i in range(900)]
    rows += [(None, start + timedelta(seconds=70 * (i // 40) + i % 3), 20_000 + i) for i in range(800)]
    rows += [("", start + timedelta(seconds=rng.randrange(900)), 30_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, t timestamp_ntz, hit_id bigint").repartition(3)
    got = limit_flags(df, 7, chunk_hits=150, rounds=rounds)
    assert {r.hit_id: r.admitted for r in got.collect()} == sequential(rows, 7)


def test_calm_stretches_keep_everything_and_cut_the_walk(spark):
    start = datetime(2026, 1, 1)
    rows = [("k", start + timedelta(seconds=20 * i), i) for i in range(300)] + [("k", start + timedelta(seconds=3000 + i % 7), 1000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, t timestamp_ntz, hit_id bigint")
    for limit in (3, 4, 6, 10):
        assert {r.hit_id: r.admitted for r in limit_flags(df, limit).collect()} == sequential(rows, limit)


def test_null_keys_are_one_key_and_null_times_have_no_flag(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([(None, t, 1), (None, t, 2), ("a", t, 3), ("a", None, 4)], "key string, t timestamp_ntz, hit_id bigint")
    assert {r.hit_id: r.admitted for r in limit_flags(df, 1).collect()} == {1: True, 2: False, 3: True, 4: None}


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_batch_flags_equal_a_sequential_run(spark, limit):
    rows = hits()
    df = spark.createDataFrame(rows, "key string, t timestamp_ntz, hit_id bigint").repartition(5)
    got = {r.hit_id: r.admitted for r in limit_flags(df, limit).collect()}
    assert got == sequential(rows, limit)
    waits = limit_flags(df, limit).agg(F.min("wait_seconds"), F.max("wait_seconds"), F.count_if(F.col("admitted") == F.col("wait_seconds").isNull())).first()
    assert 0 < waits[0] and waits[1] <= 60 and waits[2] == len(rows)


def test_stream_flags_equal_the_batch_twin(spark, tmp_path):
    rows = sorted(hits(900), key=lambda r: r[1])
    for part in range(3):
        chunk = rows[part * 300:(part + 1) * 300]
        spark.createDataFrame(chunk, "key string, t timestamp_ntz, hit_id bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_folder(spark, str(tmp_path / "in"), "key string, t timestamp_ntz, hit_id bigint", files_per_batch=1)
    root = str(tmp_path / "out")
    jobs.run_refresh(stream, jobs.limiter(root, 3, chunk_hits=100), str(tmp_path / "ck"))
    assert {r.hit_id: r.admitted for r in jobs.current_flags(spark, root).collect()} == sequential(rows, 3)
    assert spark.read.parquet(f"{root}/passed/batch=000000002").groupBy("key").count().agg(F.max("count")).first()[0] <= 3


def test_a_backlog_with_a_hot_key_late_hits_and_null_keys(spark, tmp_path):
    start, root = datetime(2026, 1, 1), str(tmp_path / "out")
    first = [("hot", start + timedelta(milliseconds=100 * i), i) for i in range(4000)] + [(None, start + timedelta(seconds=i), 9000 + i) for i in range(200)]
    late = [("hot", start + timedelta(seconds=10 + i), 5000 + i) for i in range(5)] + [("hot", start + timedelta(seconds=401 + i), 5100 + i) for i in range(50)] + [("cold", None, 7000)]
    flag = jobs.limiter(root, 10, chunk_hits=500)
    for number, rows in enumerate((first, late)):
        for _ in range(2):  # a repeated batch changes nothing
            flag(spark.createDataFrame(rows, "key string, t timestamp_ntz, hit_id bigint"), number)
    got = {r.hit_id: r.admitted for r in jobs.current_flags(spark, root).collect()}
    passed_before = max(t for k, t, h in first if k == "hot" and got[h])
    moved = [(k, max(t, passed_before) if t and k == "hot" else t, h) for k, t, h in late]
    assert got == sequential([r for r in first + moved if r[1]], 10) | {7000: None}


def test_stream_intent_events_give_the_batch_intent(spark, sf_dir, tmp_path):
    ws = Workspace(spark, sf_dir)
    acts = ws.activities
    acts.repartition(2).write.parquet(str(tmp_path / "in"))
    acts.limit(100).write.mode("append").parquet(str(tmp_path / "in"))  # the same events once more
    schema = "activity_id string, lead_id string, type string, occurred_at timestamp_ntz"
    stream = jobs.stream_folder(spark, str(tmp_path / "in"), schema)
    jobs.drain(jobs.intent_events(stream, ws.as_of, "60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    written = spark.read.parquet(str(tmp_path / "out"))
    want = {r.lead_id: r._cents for r in intent_totals(acts, ws.as_of).collect()}
    assert {r.lead_id: r._cents for r in intent_totals(written, ws.as_of).collect()} == want and want


def test_refresh_stream_equals_full_scores(spark, sf_dir, tmp_path):
    ws = Workspace(spark, sf_dir)
    acts = ws.activities
    for part in range(2):
        acts.filter(F.pmod(F.xxhash64("activity_id"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "activity_id string, lead_id string, type string, occurred_at timestamp_ntz"
    stream = jobs.stream_folder(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    root = str(tmp_path / "tables")
    jobs.run_refresh(stream, jobs.refresher(root, ws.leads, ws.companies, ws.as_of), str(tmp_path / "ck"))
    base = score_leads(ws.leads, ws.companies, acts.limit(0), ws.as_of)
    got = {tuple(r) for r in jobs.current_scores(spark, root, base).collect()}
    want = {tuple(r) for r in score_leads(ws.leads, ws.companies, acts, ws.as_of).select(*base.columns).collect()}
    assert got == want
    touched = acts.select("lead_id").distinct()
    full = stale_issues(ws.leads, ws.as_of, touched).unionByName(missing_issues(ws.leads, touched)).select("lead_id", "issue_type", "details")
    assert {tuple(r) for r in jobs.current_issues(spark, root).collect()} == {tuple(r) for r in full.collect()}


def test_ledger_reports_and_stream(spark, tmp_path):
    rows = [{"at": f"2026-09-{10 + i % 3}T1{i % 4}:30:00+00:00", "provider": "p", "model": "m", "purpose": ["ask", "", "draft"][i % 3], "ok": i % 5 != 0,
             "total_tokens": 100 + i, "latency_ms": i, "error": None if i % 5 else f"timeout {i % 2}"} for i in range(40)]
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    entries = read_ledger(spark, str(folder))
    ok = [r for r in rows if r["ok"]]
    total = ledger_totals(entries).first()
    assert (total.calls, total.ok, total.failed, total.tokens) == (40, len(ok), 40 - len(ok), sum(r["total_tokens"] for r in ok))
    by = {r.purpose: (r.tokens, r.calls, r.tokens_per_call) for r in ledger_by_purpose(entries).collect()}
    for name in ("ask", "other", "draft"):
        mine = [r["total_tokens"] for r in ok if (r["purpose"] or "other") == name]
        assert by[name] == (sum(mine), len(mine), sum(mine) // len(mine))
    assert [tuple(r) for r in ledger_errors(entries).collect()] == [("timeout 0", 4), ("timeout 1", 4)]
    assert read_ledger(spark, str(folder), "2026-09-11").count() == sum(r["at"] >= "2026-09-11" for r in rows)
    stream = jobs.ledger_windows(jobs.ledger_stream(spark, str(folder)))
    query = (stream.writeStream.outputMode("update").format("memory").queryName("ledger_out")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.purpose: r.t for r in spark.sql("SELECT purpose, sum(tokens) AS t FROM ledger_out GROUP BY purpose").collect()}
    assert got == {k: v[0] for k, v in by.items()}
