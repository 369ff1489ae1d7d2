"""Duplicates kept up to date over batches of new, changed and deleted leads.

Below a folder lie the normalized people and the duplicate rows with the names and the address they rest on, as versions. A row
depends on the records of its two names at its company, or on those of its address, and on nothing else. So a batch takes away
the rows of the names and addresses that it touches, before or after the change, and finds these again: the touched names meet all
names of their companies, and only records of names that match them are read. The result is that of `find_duplicates` over all
leads. A company that gets another name changes all its leads; they belong to the batch.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.operators.dedup import NAME_KEY, classes, email_rows, matching_names, name_rows, people
from salesloom.sources.storage import written
from salesloom.sources.tables import read_latest, replace_rows

RESULT = ["lead_id", "related_lead_id", "reason"]
_ROWS = [*RESULT, "email", "block", "first", "last", "related_first", "related_last"]


def _resting_on(by_email: DataFrame, by_name: DataFrame, persons: DataFrame) -> DataFrame:
    """Rows with the address, or the company and both names, that they rest on."""
    own = persons.select("lead_id", "email", *NAME_KEY)
    related = persons.select(F.col("lead_id").alias("related_lead_id"), F.col("first").alias("related_first"), F.col("last").alias("related_last"))
    nothing = F.lit(None).cast("string")
    mails = by_email.join(own, "lead_id").select(*RESULT, "email", *[nothing.alias(c) for c in _ROWS[4:]])
    return mails.unionByName(by_name.join(own.drop("email"), "lead_id").join(related, "related_lead_id").select(*RESULT, nothing.alias("email"), *_ROWS[4:]))


def build(leads: DataFrame, root: str) -> None:
    """The index of all leads (columns as for `find_duplicates`) below `root`."""
    replace_rows(people(leads), f"{root}/people")
    persons = read_latest(leads.sparkSession, f"{root}/people")
    names = name_rows(persons, written(classes(persons), "classes"), written(matching_names(persons), "matches"))
    replace_rows(_resting_on(email_rows(persons), names, persons), f"{root}/rows")


def apply_batch(spark: SparkSession, root: str, upserts: DataFrame, deleted: DataFrame) -> None:
    """New versions of the index after `upserts` (whole leads) and `deleted(lead_id)`."""
    before, rows = read_latest(spark, f"{root}/people"), read_latest(spark, f"{root}/rows")
    new = written(people(upserts), "people")
    ids = new.select("lead_id").unionByName(deleted.select("lead_id")).distinct()
    touched = written(before.join(ids, "lead_id", "left_semi").select(*new.columns).unionByName(new), "touched")
    replace_rows(before.join(ids, "lead_id", "left_anti").select(*new.columns).unionByName(new), f"{root}/people")
    index = read_latest(spark, f"{root}/people")
    mails = touched.filter("email IS NOT NULL").select("email").distinct()
    names = touched.select(*NAME_KEY).distinct()

    def without(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
        """Rows of df whose `columns` are not among the keys; rows without them stay."""
        same = [F.col(f"r.{c}") == F.col(f"k.{k}") for c, k in zip(columns, keys.columns)]
        return df.alias("r").join(keys.alias("k"), same, "left_anti").select("r.*")
    kept = without(without(without(rows, mails, ["email"]), names, NAME_KEY), names, ["block", "related_first", "related_last"])

    company = index.join(names.select("block").distinct(), "block", "left_semi")
    mine = written(company.join(names, NAME_KEY, "left_semi").select(*index.columns), "mine")
    pairs = written(matching_names(mine, company).unionByName(matching_names(company, mine)).distinct(), "names")
    sides = [pairs.select("block", F.col(f"first_{s}").alias("first"), F.col(f"last_{s}").alias("last")) for s in ("old", "new")]
    partners = company.join(sides[0].unionByName(sides[1]).distinct(), NAME_KEY, "left_semi").select(*index.columns)
    found = name_rows(mine, written(classes(partners), "classes"), pairs)
    again = _resting_on(email_rows(index.join(mails, "email", "left_semi").select(*index.columns)), found, index)
    replace_rows(kept.select(*_ROWS).unionByName(again.select(*_ROWS)), f"{root}/rows")


def duplicates(spark: SparkSession, root: str) -> DataFrame:
    """(lead_id, related_lead_id, reason) as of the newest version."""
    return read_latest(spark, f"{root}/rows").select(*RESULT)
