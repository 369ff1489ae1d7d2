import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from salesloom.operators import evaluate as E
from salesloom.operators.evidence import CELL_TYPE


def test_precision_recall_and_empty_sets(spark):
    found = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (1, 2)], "a int, b int")
    truth = spark.createDataFrame([(1, 2), (7, 8)], "a int, b int")
    assert tuple(E.precision_recall(found, truth, ["a", "b"]).first()) == (0.3333, 0.5, 0.4, 3, 2)
    assert tuple(E.precision_recall(found.limit(0), truth, ["a", "b"]).first()) == (0.0, 0.0, 0.0, 0, 2)
    assert tuple(E.precision_recall(found, truth.limit(0), ["a", "b"]).first()) == (0.0, 0.0, 0.0, 3, 0)


def test_answers_and_grades(spark):
    def row(*cells):
        return [(n, v if isinstance(v, str) else None, v if isinstance(v, int) else None, v if isinstance(v, float) else None) for n, v in cells]
    rows = [("S", "scalar", 0, row(("name", "x"), ("n", 7), ("m", 9.5))), ("S", "scalar", 1, row(("n", 8))),
            ("I", "id_set", 0, row(("lead_id", "LD-00002"), ("n", 1))), ("I", "id_set", 1, row(("name", "z"), ("lead_id", "LD-00001"))), ("I", "id_set", 2, row(("lead_id", "LD-00002"))),
            ("T", "table", 0, row(("owner", "Maya"), ("n", 3))), ("T", "table", 1, row(("owner", "Bo"), ("v", 2.04)))]
    df = spark.createDataFrame([(q, 0, k, n, c) for q, k, n, c in rows], f"question_id string, run_id int, kind string, row_no bigint, cells array<{CELL_TYPE}>")
    got = E.answer_table(df)
    assert sorted((r.question_id, r.key, r.value) for r in got.collect() if r.value is not None) == [("S", "", 7.0), ("T", "bo", 2.04), ("T", "maya", 3.0)]
    assert sorted(r.key for r in got.collect() if r.value is None) == ["LD-00001", "LD-00002"]
    kinds = {"S": "scalar", "I": "id_set", "T": "table", "D": "decline", "E": "decline", "N": "scalar", "Z": "id_set"}
    asked = spark.createDataFrame([(q, 0, k, q not in ("D", "N")) for q, k in kinds.items()], "question_id string, run_id int, kind string, answered boolean")
    good = [("S", "", 7.05), ("I", "LD-00001", None), ("I", "LD-00002", None), ("T", "MAYA", 3.0), ("T", "Bo", 2.0), ("N", "", 1.0)]
    def passed(rows):
        want = spark.createDataFrame(rows, "question_id string, key string, value double")
        return {r.question_id: r.passed for r in E.grade(got, want, asked).collect()}
    assert passed(good) == {"S": True, "I": True, "T": True, "D": True, "E": False, "N": False, "Z": True}
    bad = [("S", "", 7.06), ("I", "LD-00001", None), ("T", "maya", 3.0), ("T", "bo", 2.2), ("Z", "LD-00009", None)]
    assert passed(bad) == {"S": False, "I": False, "T": False, "D": True, "E": False, "N": False, "Z": False}


def rank(values, p):
    return sorted(values)[max(0, math.ceil(p / 100 * len(values)) - 1)] if values else 0


def test_nearest_ranks_of_groups_of_any_size(spark):
    """One run has nearly all rows; others have few, equal, negative, missing or no values."""
    rng = random.Random(5)
    groups = {f"n{n}": [rng.randint(0, 1000) for _ in range(n)] for n in (1, 2, 3, 10, 19, 20, 40, 101)}
    groups |= {"hot": [int(rng.lognormvariate(8, 2)) for _ in range(20_000)], "equal": [7] * 300, "wide": [-10**15, -3, 0, 10**15], "none": [], None: [4, 5, 6, 6]}
    rows = [(g, v, -v) for g, values in groups.items() for v in values] + [("none", None, None), ("n3", None, None)]
    df = spark.createDataFrame(rows, "run string, v bigint, w bigint").repartition(7)
    got = E.nearest_ranks(df, ["run"], {"p50": ("v", 50), "p95": ("v", 95), "first": ("v", 0), "last": ("v", 100), "w5": ("w", 5)})
    assert {r.run: tuple(r)[1:] for r in got.collect()} == {
        g: (rank(v, 50), rank(v, 95), rank(v, 0), rank(v, 100), rank([-x for x in v], 5)) for g, v in groups.items()}
    assert E.nearest_ranks(df.limit(0), ["run"], {"p50": ("v", 50)}).collect() == []


def test_summary_spread_and_stability(spark):
    rng = random.Random(4)
    rows = [(f"Q{i % 40:02d}", i // 40, rng.random() < 0.7 and i % 40 != 3, rng.random() < 0.8, rng.random() < 0.9, rng.randint(1, 3), rng.randint(1, 2),
             rng.choice(["none", "template", "rules"]), rng.randint(1, 900), rng.choice([None, 0, 50]), rng.randint(0, 99), rng.randint(0, 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "question_id string, run_id int, passed boolean, answered boolean, valid boolean, sql_attempts int, answer_attempts int, "
                                     "fallback string, latency_ms int, backoff_ms int, tokens int, rate_limited int")
    summaries = {r.run_id: r for r in E.run_summary(df).collect()}
    for run in range(3):
        mine = [r for r in rows if r[1] == run]
        s = summaries[run]
        assert (s.total, s.passed, s.accuracy) == (40, sum(r[2] for r in mine), round(sum(r[2] for r in mine) / 40, 4))
        ok = [r for r in mine if r[3]]
        assert (s.answered, s.citation_valid_rate) == (len(ok), round(sum(r[4] for r in ok) / len(ok), 4))
        assert s.sql_retries == sum(r[5] - 1 for r in mine) and s.fallback_rules == sum(r[7] == "rules" for r in mine)
        assert s.p95_latency_ms == sorted(r[8] for r in mine)[37] and s.tokens == sum(r[10] for r in mine)
        assert s.p50_latency_ex_backoff_ms == sorted(r[8] - (r[9] or 0) for r in mine)[19]
    spread = {r.measure: r for r in E.run_spread(E.run_summary(df)).collect()}
    acc = [s.accuracy for s in summaries.values()]
    assert (spread["accuracy"].mean, spread["accuracy"].stdev, spread["accuracy"].min) == (round(statistics.mean(acc), 4), round(statistics.pstdev(acc), 4), min(acc))
    passes = {q: sum(r[2] for r in rows if r[0] == q) for q in {r[0] for r in rows}}
    got = {r.question_id: (r.passes, r.status) for r in E.question_stability(df).collect()}
    assert got == {q: (n, "always failing" if n == 0 else "unstable") for q, n in passes.items() if n < 3} and got["Q03"] == (0, "always failing")


def test_recall_and_traps(spark):
    found = spark.createDataFrame([("a", "b"), ("c", "d"), ("x", "y")], "a string, b string")
    truth = spark.createDataFrame([("a", "b", "k1"), ("e", "f", "k1"), ("c", "d", "k2")], "a string, b string, kind string")
    traps = spark.createDataFrame([("x", "y", "t1"), ("p", "q", "t2")], "a string, b string, kind string")
    assert [tuple(r) for r in E.recall_by_kind(found, truth).collect()] == [("k1", 1, 2), ("k2", 1, 1)]
    assert [tuple(r) for r in E.trap_hits(found, traps).collect()] == [("t1", 1)]
    assert [tuple(r) for r in E.false_positives(found, truth, traps).collect()] == [("x", "y", "t1")]
    assert spark.createDataFrame([("b", "a")], "p string, q string").select(*E.pair_key("p", "q")).first() == ("a", "b")
