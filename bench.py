"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_leads", "find_duplicates", "detect_issues",  # full rebuilds of the derived tables
    "overview_totals", "overview_stages", "overview_histogram", "overview_top_leads", "lead_list_whole", "lead_list_page_2", "issue_list",
    "q17_recent_activities", "q22_stale_of_owner", "q27_top_open_fintech", "q43_score_by_industry", "q46_demos_by_industry", "h21_clean_education",
    "metric_activities_by_type", "metric_stale_by_industry",
    "score_contributions", "score_breakdowns", "why_now_notes", "note_audit",
    "import_records", "import_companies", "executed_leads", "table_fingerprints", "limit_flags", "run_summary", "ledger_by_purpose",
    "import_csv_files", "stream_limit_flags", "stream_scores",
    "import_csv_documents", "queue_outcomes", "advanced_scores", "kept_fingerprints", "issue_page_stored",
]


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    from salesloom.plans import workspace
    from salesloom.plans.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine: its disk is the shared folder
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, warm = {}, {}
    for seconds in (times, warm):  # cold, then once more from the given tables: results stored by the first pass are forgotten
        workspace._STORED.clear()
        ws = workspace.Workspace(spark, sf_dir)
        start = time.perf_counter()
        ws.leads, ws.companies, ws.lead_scores, ws.data_issues  # the stored tables the queries read
        seconds["build_tables"] = round(time.perf_counter() - start, 3)
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "warm": warm, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
