"""Advancing the clock in steps gives what a full rebuild gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from salesloom.operators import calendar as C
from salesloom.sources.tables import SCHEMAS

START = datetime(2026, 3, 1, 12)


def crm(spark, seed, n=150):
    rng = random.Random(seed)

    def ago(days):
        return START - timedelta(days=days, seconds=rng.randrange(86400))
    leads, acts = [], []
    for i in range(n):
        contact = rng.choice([None, ago(0), ago(1), ago(5), ago(rng.randrange(7, 40)), ago(rng.randrange(80, 100)), ago(rng.randrange(280, 300)), START - timedelta(days=rng.choice([2, 7, 30, 90, 290]))])
        stage = rng.choice(["new", "contacted", "won", "lost", "qualified", None])
        leads.append((f"LD-{i:05d}", rng.choice(["CO-1", None]), "A", "B", "e", "p", "t", rng.choice(["vp", ""]), "web", stage, 1.0, "o", ago(rng.choice([3, 88, 200])), contact, START))
        if rng.random() < 0.4:
            acts += [(f"ACT-{i}-{k}", f"LD-{i:05d}", rng.choice(["call", "demo_request", "email_open"]), START + timedelta(days=rng.randrange(-45, 25), seconds=rng.randrange(86400))) for k in range(rng.randint(1, 3))]
    firms = spark.createDataFrame([("CO-1", "Acme", "a.com", "Software", 300, "US", START)], SCHEMAS["companies"])
    return spark.createDataFrame(leads, SCHEMAS["leads"]), firms, spark.createDataFrame(acts, SCHEMAS["activities"])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_steps_equal_a_full_rebuild(spark, tmp_path, seed):
    leads, firms, acts = (df.cache() for df in crm(spark, seed))
    root, before = str(tmp_path / "c"), START
    C.start(leads, firms, acts, before, root)
    computed = []
    for step, after in enumerate([timedelta(0), timedelta(microseconds=1), timedelta(hours=5), timedelta(days=1), timedelta(days=8), timedelta(days=100)], 1):
        now = before + after
        computed.append(C.advance(spark, leads, firms, acts, before, now, root, step).count())
        assert rows(C.current(spark, root, leads)) == rows(C._state(leads, firms, acts, now)), after
        before = now
    assert computed[0] == 0 and 0 < computed[2] < leads.count()


def test_leads_without_anything_ahead_are_never_due(spark):
    old = START - timedelta(days=400)
    lead = lambda n, stage, contact: (f"LD-{n}", None, "A", "B", "e", "p", "t", "vp", "web", stage, 1.0, "o", old, contact, old)
    leads = spark.createDataFrame([lead(1, "won", old), lead(2, "lost", None), lead(3, "new", old), lead(4, "won", START)], SCHEMAS["leads"])
    got = {r.lead_id: r.due_at for r in C.due_times(leads, spark.createDataFrame([], SCHEMAS["activities"]), START).collect()}
    assert got == {"LD-1": None, "LD-2": None, "LD-3": START + timedelta(days=1), "LD-4": None}


def test_edited_and_deleted_leads(spark, tmp_path):
    leads, firms, acts = crm(spark, 3, 40)
    root = str(tmp_path / "c")
    C.start(leads, firms, acts, START, root)
    edited = leads.filter("lead_id <> 'LD-00001'").withColumn("stage", F.when(F.col("lead_id") < "LD-00010", "won").otherwise(F.col("stage")))
    C.refile(leads.filter("lead_id < 'LD-00010'").select("lead_id"), edited, firms, acts, START, root, 1)
    now = START + timedelta(days=3)
    C.advance(spark, edited, firms, acts, START, now, root, 2)
    assert rows(C.current(spark, root, edited)) == rows(C._state(edited, firms, acts, now))
    with pytest.raises(ValueError):
        C.advance(spark, edited, firms, acts, now, START, root, 3)
