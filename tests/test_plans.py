import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from salesloom.plans import registry
from oracle.compare import connect, compare
from salesloom.operators.ordering import number_rows, page_of, with_ids
from salesloom.plans import dashboard, metrics as m
from salesloom.plans.workspace import Workspace
from salesloom.sources import storage


@pytest.fixture(scope="module")
def ws(spark, sf_dir):
    return Workspace(spark, sf_dir)


@pytest.mark.parametrize("request_", [
    {"entity": "unknown"}, {"measure": "unknown"}, {"ranked": True, "group": "owner"}, {"ranked": True, "measure": "count"},
    {"where": [m.active("call"), m.active("meeting")]}, {"entity": "companies", "measure": "list"},
    {"entity": "companies", "measure": "count", "where": [m.equals("stage", "won")]}, {"entity": "companies", "measure": "count", "group": "industry"},
    {"entity": "issues", "measure": "count", "where": [m.open_stage()]}, {"entity": "issues", "measure": "count", "group": "owner"},
    {"entity": "activities", "measure": "avg_score"}, {"measure": "count", "group": "type"},
    {"where": [m.Condition("field", "stage", "=", "new", days=3)]},
])
def test_what_cannot_be_answered_is_refused(ws, request_):
    with pytest.raises(m.UnsupportedMetric):
        m.metric(ws, **request_)


def test_closed_and_lists_are_capped(ws):
    assert m.metric(ws, where=[m.closed_stage()]).filter(~F.col("stage").isin("won", "lost")).count() == 0
    assert m.metric(ws, ranked=True).count() == 10 and m.metric(ws, ranked=True, limit=999).count() <= 200


def test_pages_are_disjoint_and_cover_everything(ws):
    total = dashboard.list_leads(ws)[1].first().total
    seen = []
    for page in range(1, 5):
        seen += [r.lead_id for r in dashboard.list_leads(ws, sort="company", order="asc", page=page, page_size=50)[0].collect()]
    assert len(seen) == len(set(seen)) == total == ws.leads.count()


@pytest.mark.parametrize("bad", [{"sort": "nope"}, {"order": "up"}, {"page_size": 0}, {"page": 0}])
def test_bad_list_requests(ws, bad):
    with pytest.raises(ValueError):
        dashboard.list_leads(ws, **bad)


def test_deep_pages_use_the_dense_numbering(spark):
    df = spark.range(25_000).select((F.col("id") * 7919 % 25_000).alias("v")).repartition(6)
    assert [r.v for r in page_of(df, [F.asc("v")], 3000, 8).collect()] == list(range(23_992, 24_000))


def test_dense_numbers(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v")).repartition(7)
    got = number_rows(df, ["g", "v"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [(r.g, r.v) for r in got] == sorted((r.g, r.v) for r in got)
    old = spark.createDataFrame([("LD-123456",), ("LD-00007",)], "lead_id string")
    ids = with_ids(spark.range(3), ["id"], "lead_id", "LD", existing=old).orderBy("id").collect()
    assert [r.lead_id for r in ids] == ["LD-123457", "LD-123458", "LD-123459"]


def test_row_lookup_and_detail(ws):
    assert dashboard.row_by_id(ws, "CO-00001").count() == 1
    with pytest.raises(ValueError):
        dashboard.row_by_id(ws, "AX-00001")
    lead = ws.data_issues.filter("issue_type = 'duplicate'").first()
    detail = dashboard.lead_detail(ws, lead.related_lead_id)
    assert detail["lead"].count() == detail["breakdown"].count() == 1
    assert lead.issue_id in {r.issue_id for r in detail["issues"].collect()}
    assert detail["citations"].first().citations[0] == lead.related_lead_id


def test_scans_read_only_the_needed_columns_and_push_filters(spark, sf_dir, ws):
    plan = m.metric(ws, "activities", "count", "type", [m.active("call", 5)])._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "CartesianProduct" not in plan
    pushed = ws.leads.filter(F.col("stage") == "won").select("lead_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stage,won)" in pushed and "ReadSchema: struct<lead_id:string,stage:string>" in pushed


def test_registry_is_complete():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert set(registry.QUERIES) <= set(entry.oracle_sql())
    assert all(len(inspect.signature(q).parameters) == 2 for q in names.values())


@pytest.mark.parametrize("name", ["q22_stale_of_owner", "q46_demos_by_industry", "h22_fresh_but_quiet", "metric_activities_by_type", "overview_totals",
                                  "overview_histogram", "lead_list_whole", "detect_issues", "find_duplicates", "why_now_notes", "import_companies",
                                  "limit_flags", "graded_answers"])
def test_results_equal_the_sql(spark, sf_dir, name):
    text, ok = compare(spark, sf_dir, connect(sf_dir), entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())


def test_conditions_are_applied_or_refused(ws):
    def count(*where):
        return m.metric(ws, "activities", "count", where=where).first()[0]

    assert count(m.active(None, 20), m.active("call", 5)) == count(m.active("call", 5)) < count(m.active(None, 20))
    for bad in ([m.inactive()], [m.active("call", 0)], [m.active("call"), m.active("meeting")]):
        with pytest.raises(m.UnsupportedMetric):
            count(*bad)
    with pytest.raises(m.UnsupportedMetric):
        m.metric(ws, limit=0)
    everything = m.metric(ws).count()
    assert m.metric(ws, limit=everything - 1).count() == everything - 1
