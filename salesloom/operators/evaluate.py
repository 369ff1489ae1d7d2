"""Measures of detection quality and of answered questions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.operators.evidence import is_id
from salesloom.sources.storage import written


def _rates(tp: Column, found: Column, truth: Column) -> list[Column]:
    precision = F.when(found > 0, tp / found).otherwise(0.0)
    recall = F.when(truth > 0, tp / truth).otherwise(0.0)
    f1 = F.when(precision + recall > 0, F.lit(2) * precision * recall / (precision + recall)).otherwise(0.0)
    return [F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
            found.alias("found"), truth.alias("expected")]


def precision_recall(found: DataFrame, truth: DataFrame, key: list[str], group: str | None = None) -> DataFrame:
    """Precision, recall and F1 of two sets, overall or per group; 0 where a set is empty."""
    keys = ([group] if group else []) + key
    f = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    both = f.join(t, keys, "full_outer")
    sums = [F.coalesce(F.sum(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1)), F.lit(0)).alias("_tp"),
            F.coalesce(F.sum("_f"), F.lit(0)).alias("_found"), F.coalesce(F.sum("_t"), F.lit(0)).alias("_truth")]
    totals = both.groupBy(group).agg(*sums) if group else both.agg(*sums)
    head = [F.col(group)] if group else []
    return totals.select(*head, *_rates(F.col("_tp"), F.col("_found"), F.col("_truth")))


def pair_key(a: str, b: str) -> list[Column]:
    """An unordered pair as two ordered columns."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def cleaning_metrics(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """Per issue type against `truth(issue_type, a, b)`: duplicates as unordered pairs, missing fields as (lead, field)."""
    second = (F.when(F.col("issue_type") == "duplicate", F.col("related_lead_id"))
              .when(F.col("issue_type") == "missing_field", F.regexp_replace("details", "^Missing ", "")).otherwise(""))
    is_pair = F.col("issue_type") == "duplicate"
    found = issues.withColumn("_b", second).select(
        "issue_type", F.when(is_pair, F.least("lead_id", "_b")).otherwise(F.col("lead_id")).alias("a"),
        F.when(is_pair, F.greatest("lead_id", "_b")).otherwise(F.col("_b")).alias("b"))
    return precision_recall(found, truth, ["a", "b"], "issue_type")


def recall_by_kind(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Found and total true pairs per kind; `found(a, b)` and `truth(a, b, kind)` hold ordered pairs."""
    marked = truth.join(found.select("a", "b").distinct().withColumn("_hit", F.lit(1)), ["a", "b"], "left")
    return marked.groupBy("kind").agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("found"), F.count(F.lit(1)).alias("total")).orderBy("kind")


def trap_hits(found: DataFrame, traps: DataFrame) -> DataFrame:
    return (traps.join(found.select("a", "b").distinct(), ["a", "b"], "left_semi").groupBy("kind")
            .agg(F.count(F.lit(1)).alias("merged")))


def false_positives(found: DataFrame, truth: DataFrame, traps: DataFrame) -> DataFrame:
    """Found pairs that are not true, with the kind of trap they are, if any."""
    wrong = found.join(truth.select("a", "b"), ["a", "b"], "left_anti")
    return (wrong.join(traps.select("a", "b", F.col("kind").alias("trap")), ["a", "b"], "left").orderBy("a", "b"))


# ------------------------------------------------------------------ answers

def answer_table(rows: DataFrame) -> DataFrame:
    """Comparable form of result rows `(question_id, run_id, kind, row_no, cells)`: question_id, run_id, kind, key, value.

    scalar: the first number of the first row. id_set: the first ID of every row, once. table: first text in
    lower case with the first number, the last row winning.
    """
    number = F.get(F.filter("cells", lambda c: c["whole"].isNotNull() | c["real"].isNotNull()), F.lit(0))
    value = F.coalesce(number["real"], number["whole"].cast("double"))
    texts = F.filter("cells", lambda c: c["text"].isNotNull())
    first_id = F.get(F.filter(texts, lambda c: is_id(c["text"])), F.lit(0))["text"]
    base = rows.select("question_id", "run_id", "kind", "row_no", value.alias("number"), first_id.alias("id"),
                       F.lower(F.get(texts, F.lit(0))["text"]).alias("word"))
    group = ["question_id", "run_id", "kind"]
    scalars = (base.filter(F.col("kind") == "scalar").groupBy(*group).agg(F.min_by("number", "row_no").alias("value"))
               .filter(F.col("value").isNotNull()).select(*group, F.lit("").alias("key"), "value"))
    ids = (base.filter((F.col("kind") == "id_set") & F.col("id").isNotNull()).select(*group, F.col("id").alias("key")).distinct()
           .withColumn("value", F.lit(None).cast("double")))
    tables = (base.filter((F.col("kind") == "table") & F.col("word").isNotNull() & F.col("number").isNotNull())
              .groupBy(*group, F.col("word").alias("key")).agg(F.max_by("number", "row_no").alias("value")))
    return scalars.unionByName(ids).unionByName(tables)


def close(got: Column, expected: Column) -> Column:
    """Equal up to rounding to one decimal or one in a thousand."""
    return F.abs(got - expected) <= F.greatest(F.lit(0.051), F.lit(0.001) * F.abs(expected))


def grade(got: DataFrame, expected: DataFrame, asked: DataFrame) -> DataFrame:
    """`question_id, run_id, passed` for `asked(question_id, run_id, kind, answered)`.

    `got(question_id, run_id, key, value)` and `expected(question_id, key, value)` are long answer tables. A
    declined question passes when nothing was queried.
    """
    runs = asked.select("question_id", "run_id", "kind", "answered")
    wanted = runs.join(expected.select("question_id", F.lower("key").alias("_k"), F.col("key").alias("_raw"), F.col("value").alias("_want")), "question_id")
    wanted = wanted.select("question_id", "run_id", F.when(F.col("kind") == "table", F.col("_k")).otherwise(F.col("_raw")).alias("key"), "_want",
                           F.lit(True).alias("_in_want"))
    have = got.select("question_id", "run_id", "key", F.col("value").alias("_got"), F.lit(True).alias("_in_got"))
    cells = have.join(wanted, ["question_id", "run_id", "key"], "full_outer")
    agrees = (F.col("_in_got").isNotNull() & F.col("_in_want").isNotNull()
              & (F.col("_got").isNull() & F.col("_want").isNull() | F.coalesce(close(F.col("_got"), F.col("_want")), F.lit(False))))
    verdict = cells.groupBy("question_id", "run_id").agg(F.every(agrees).alias("_same"), F.bool_or(F.col("_in_got").isNotNull()).alias("_any_got"))
    passed = (F.when(F.col("kind") == "decline", ~F.col("answered"))
              .when(~F.col("answered"), F.lit(False))
              .otherwise(F.coalesce("_same", F.col("kind") != "scalar")))
    return runs.join(verdict, ["question_id", "run_id"], "left").select("question_id", "run_id", passed.alias("passed"))


BINS = 256


def _same_group(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])


def nearest_ranks(df: DataFrame, by: list[str], ranks: dict[str, tuple[str, int]]) -> DataFrame:
    """`by` and, for each name in `ranks`, the nearest-rank percentile of a whole-number column: the smallest value with at least
    that percent of all values at or below it, 0 where there are none. `ranks` has (column, percent).

    The range that holds a rank is cut into `BINS` bins, the rows in each are counted, and the bin with the rank is the next range,
    until it is one value: a pass for each eight bits of the range. Counts are combined before the shuffle, so no task ever holds
    the values of a group, however large it is.
    """
    measures = list(dict.fromkeys(column for column, _ in ranks.values()))
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value")) for m in measures])).alias("m"))
    rows = rows.select(*by, "m.measure", "m.value").filter(F.col("value").isNotNull())
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(column).alias("of"), F.lit(percent).alias("percent")) for name, (column, percent) in ranks.items()]))
    sizes = rows.groupBy(*by, "measure").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    state = sizes.select("*", asked.alias("a")).filter("a.of = measure").select(
        *by, "measure", "a.name", "low", "high", F.greatest(F.lit(1), F.ceil(F.col("a.percent") * F.col("n") / 100)).alias("rank"))
    state = written(state, "ranks")
    key = [*by, "measure"]
    while not state.filter("low < high").isEmpty():
        open_ = state.filter("low < high").withColumn("width", F.floor((F.col("high") - F.col("low")) / BINS) + 1)
        met = rows.alias("r").join(open_.alias("s"), _same_group("r", "s", key) & F.expr("r.value BETWEEN s.low AND s.high"))
        bins = met.groupBy(*[F.col(f"s.{c}").alias(c) for c in [*key, "name", "low", "high", "rank", "width"]], F.floor((F.col("r.value") - F.col("s.low")) / F.col("s.width")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy(*key, "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # `BINS` rows
        placed = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before < rank AND rank <= before + n")
        low = F.col("low") + F.col("bin") * F.col("width")
        found = placed.select(*key, "name", low.alias("low"), F.least(F.col("high"), low + F.col("width") - 1).alias("high"), (F.col("rank") - F.col("before")).alias("rank"))
        state = written(state.filter("low = high").unionByName(found), "ranks")
    wide = state.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks])
    groups = df.select(*by).distinct()
    return groups.alias("r").join(wide.alias("s"), _same_group("r", "s", by), "left").select(*[F.col(f"r.{c}") for c in by], *[F.coalesce(F.col(f"s.{name}"), F.lit(0)).alias(name) for name in ranks])


def run_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, validity, retries, fallbacks and latencies of graded answers, per run.

    `results(run_id, passed, answered, valid, sql_attempts, answer_attempts, fallback, latency_ms, backoff_ms, tokens, rate_limited)`.
    """
    rows = results.withColumn("_net", F.col("latency_ms") - F.coalesce("backoff_ms", F.lit(0)))
    n = F.count(F.lit(1))
    answered = F.count_if("answered")

    def share(part: Column, whole: Column) -> Column:
        return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 4)

    good = F.count_if(F.col("answered") & F.col("valid"))
    retried = F.count_if((F.col("sql_attempts") > 1) | (F.col("answer_attempts") > 1))
    fell_back = F.count_if(F.col("fallback") != "none")
    groups = by or ["run_id"]
    measured = rows.groupBy(*groups).agg(
        n.alias("total"), F.count_if("passed").alias("passed"), share(F.count_if("passed"), n).alias("accuracy"),
        answered.alias("answered"), (n - answered).alias("declined"), share(good, answered).alias("citation_valid_rate"),
        F.count_if(F.col("answered") & ~F.col("valid")).alias("hallucinated_citations"), share(retried, n).alias("retry_rate"),
        F.sum(F.greatest(F.col("sql_attempts") - 1, F.lit(0))).alias("sql_retries"),
        F.sum(F.greatest(F.col("answer_attempts") - 1, F.lit(0))).alias("answer_retries"), share(fell_back, n).alias("fallback_rate"),
        F.count_if(F.col("fallback") == "template").alias("fallback_template"), F.count_if(F.col("fallback") == "rules").alias("fallback_rules"),
        F.bround(F.avg("latency_ms"), 0).cast("bigint").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"), F.sum(F.coalesce("backoff_ms", F.lit(0))).alias("backoff_ms"),
        F.sum("tokens").alias("tokens"), F.sum("rate_limited").alias("rate_limited"))
    ranks = nearest_ranks(rows, groups, {"p50_latency_ms": ("latency_ms", 50), "p95_latency_ms": ("latency_ms", 95),
                                         "p50_latency_ex_backoff_ms": ("_net", 50), "p95_latency_ex_backoff_ms": ("_net", 95)})
    met = measured.alias("r").join(ranks.alias("s"), _same_group("r", "s", groups))
    return met.select("r.*", *[F.col(f"s.{c}") for c in ranks.columns if c not in groups])


def passed_by(results: DataFrame, column: str) -> DataFrame:
    """Passed and total per category or per source."""
    return results.groupBy("run_id", column).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).orderBy("run_id", column)


SPREAD_MEASURES = ("accuracy", "citation_valid_rate", "retry_rate", "fallback_rate", "p50_latency_ms", "p95_latency_ms",
                   "p50_latency_ex_backoff_ms", "p95_latency_ex_backoff_ms")


def run_spread(summaries: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of the main measures over runs."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in SPREAD_MEASURES])).alias("m")
    return summaries.select(rows).select("m.*").groupBy("measure").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("stdev"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def question_stability(results: DataFrame) -> DataFrame:
    """Questions that pass in some runs only, or in none."""
    runs = results.agg(F.count_distinct("run_id").alias("_runs"))
    counted = results.groupBy("question_id").agg(F.count_if("passed").alias("passes"))
    status = F.when(F.col("passes") == 0, "always failing").when(F.col("passes") < F.col("_runs"), "unstable")
    return (counted.crossJoin(F.broadcast(runs)).withColumn("status", status)  # one row
            .filter(F.col("status").isNotNull()).select("question_id", "passes", "status"))
