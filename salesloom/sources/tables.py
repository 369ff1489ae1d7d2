"""Table schemas, appends, full refreshes as new versions, and JSON snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "companies": "company_id string, name string, domain string, industry string, employees int, country string, "
                 "created_at timestamp_ntz",
    "leads": "lead_id string, company_id string, first_name string, last_name string, email string, phone string, title string, "
             "seniority string, source string, stage string, deal_value double, owner string, created_at timestamp_ntz, "
             "last_contacted_at timestamp_ntz, updated_at timestamp_ntz",
    "activities": "activity_id string, lead_id string, type string, occurred_at timestamp_ntz",
    "data_issues": "issue_id string, lead_id string, issue_type string, details string, related_lead_id string",
    "lead_scores": "lead_id string, score double, fit double, intent double, recency double",
    "actions": "action_id string, type string, lead_ids array<string>, payload_json string, status string, "
               "created_at timestamp_ntz, decided_at timestamp_ntz, decided_by string, note string",
    "audit_log": "id bigint, action_id string, event string, at timestamp_ntz, actor string",
    "stored_results": "kind string, key string, payload string, deps string, created_at timestamp_ntz, hits int",
}
# Primary key and further columns that must not be NULL.
CONSTRAINTS = {
    "companies": (["company_id"], ["name"]),
    "leads": (["lead_id"], []),
    "activities": (["activity_id"], ["lead_id", "type", "occurred_at"]),
    "data_issues": (["issue_id"], ["lead_id", "issue_type"]),
    "lead_scores": (["lead_id"], ["score", "fit", "intent", "recency"]),
    "actions": (["action_id"], ["type", "lead_ids", "payload_json"]),
    "audit_log": (["id"], []),
    "stored_results": (["kind", "key"], []),
}
QUERYABLE_TABLES = ("companies", "leads", "activities", "data_issues", "lead_scores")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_activities(df: DataFrame, path: str) -> None:
    """Events by day and clustered by lead: trailing windows prune days, lead look-ups prune row groups."""
    (df.withColumn("day", F.to_date("occurred_at")).repartition("day", F.pmod(F.xxhash64("lead_id"), F.lit(16)))
     .sortWithinPartitions("day", "lead_id").write.mode("append").partitionBy("day").parquet(path))


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions below a table folder, from the file listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = []
    for entry in system.listStatus(path):
        name = entry.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version-") and system.exists(marker):
            done.append(int(name.removeprefix("version-")))
    return sorted(done)


def replace_rows(df: DataFrame, root: str) -> str:
    """Full refresh: the rows become a new version, readers move on once it is complete."""
    spark = df.sparkSession
    version = max(_versions(spark, root), default=0) + 1
    target = f"{root.rstrip('/')}/version-{version:06d}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_latest(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    versions = _versions(spark, root)
    if not versions:
        raise FileNotFoundError(root)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/version-{versions[-1]:06d}")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields kept."""
    df.write.option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


QUESTION_SCHEMA = "id string, category string, kind string, question string, reference_sql string, expected variant"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets as JSON lines; `expected` is a number, a list of IDs or a map, so it stays a variant."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)
