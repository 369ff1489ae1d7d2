"""The five CRM tables of one data set: three base views and the two stored derived tables."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from salesloom.operators.quality import detect_issues
from salesloom.operators.scoring import score_leads
from salesloom.plans.fixture import FIXTURE_AS_OF, crm_view
from salesloom.sources.storage import shared_folder, written

_STORED: dict[tuple[str, str, str, str], object] = {}


@dataclass(frozen=True)
class Workspace:
    """Base tables are lazy views; scores and issues are computed once per data set and read back as Parquet.

    The derived tables are what other jobs filter, count and page, so they are stored like any other
    table instead of being recomputed inside every query.
    """

    spark: SparkSession
    sf_dir: str
    as_of: datetime = FIXTURE_AS_OF

    def once(self, name: str, build):
        """The result of `build`, made once per session and data set."""
        key = (self.spark.sparkContext.applicationId, shared_folder(self.spark), self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = build()
        return _STORED[key]

    def _stored(self, name: str, build) -> DataFrame:
        return self.once(name, lambda: written(build(), name))

    @property
    def companies(self) -> DataFrame:
        return self._stored("companies", lambda: crm_view(self.spark, self.sf_dir, "companies"))

    @property
    def leads(self) -> DataFrame:
        return self._stored("leads", lambda: crm_view(self.spark, self.sf_dir, "leads"))

    @property
    def activities(self) -> DataFrame:
        return crm_view(self.spark, self.sf_dir, "activities")

    @property
    def lead_scores(self) -> DataFrame:
        return self._stored("lead_scores", lambda: score_leads(self.leads, self.companies, self.activities, self.as_of))

    @property
    def data_issues(self) -> DataFrame:
        return self._stored("data_issues", lambda: detect_issues(self.leads, self.companies, self.as_of))
