import hashlib

from pyspark.sql import functions as F

from salesloom.functions.text import normalize_question
from salesloom.operators import fingerprint as fp
from salesloom.plans.workspace import Workspace


def mark(df):
    return fp.table_fingerprint(df, "t").first().fingerprint


def test_fingerprint_notices_content_and_not_order(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "c")], "x string, y string")
    assert mark(df) == mark(df.orderBy(F.desc("y")).repartition(3))
    assert mark(df) != mark(df.filter("x = 'b'").unionByName(spark.createDataFrame([("a", None), ("a", None)], df.schema)))
    assert mark(spark.createDataFrame([("a", None)], df.schema)) != mark(spark.createDataFrame([(None, "a")], df.schema))
    once, thrice = df.limit(1), df.limit(1).union(df.limit(1)).union(df.limit(1))
    assert len({mark(once), mark(thrice), mark(df.limit(0))}) == 3


def test_question_normalization(spark):
    texts = ["  Top 10\tLEADS?! ", '"How many leads?"', "how  many\nleads", "Ｔｏｐ １０ leads…", "‘a’ ?", "½ off . . ."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(normalize_question(F.col("t")).alias("n")).collect()]
    assert got == ["top 10 leads", "how many leads", "how many leads", "top 10 leads", "‘a’", "1⁄2 off"]
    key = spark.range(1).select(fp.result_key(F.lit("ask"), F.lit("Top?"), F.lit("v")).alias("k")).first().k
    assert key == hashlib.sha256("ask\x1fv\x1ftop".encode()).hexdigest()[:16]


def test_only_results_that_read_a_changed_table_go(spark, sf_dir, tmp_path):
    ws = Workspace(spark, sf_dir)
    frames = {"companies": ws.companies, "leads": ws.leads, "activities": ws.activities}
    before = fp.snapshot(frames)
    results = spark.createDataFrame([("ask", "k1", "{}", ["leads", "companies"]), ("ask", "k2", "{}", ["companies"]), ("ask", "k3", "{}", []),
                                     ("explain", "k1", "{}", ["activities"])], "kind string, key string, payload string, tables array<string>")
    entries = fp.store_results(results, before)
    assert fp.valid_entries(entries, before).count() == 4
    moved = ws.leads.withColumn("stage", F.when(F.col("lead_id") == "LD-00003", "lost").otherwise(F.col("stage")))
    after = fp.snapshot({**frames, "leads": moved})
    assert {(r.kind, r.key) for r in fp.valid_entries(entries, after).collect()} == {("ask", "k2"), ("ask", "k3"), ("explain", "k1")}
    fp.export_entries(entries, after, str(tmp_path / "seed"))
    assert fp.load_entries(spark, str(tmp_path / "seed"), after).count() == 3
    assert {r.key for r in fp.load_entries(spark, str(tmp_path / "seed"), before.filter("table = 'activities'")).collect()} == {"k1", "k3"}
