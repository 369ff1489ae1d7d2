import importlib
import re

import pytest

from llm.helpers import docs, rows_of


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_keep_the_columns(spark, sf_dir, pipeline):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = table
    counts = []
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        if name != "sentencepiece":
            assert after.columns == table.columns, name
            after = spark.createDataFrame(after.collect(), table.schema)
            assert after.where("n_chars <> length(text)").count() == 0
        counts.append(after.count())
        before = after
    assert counts[0] <= table.count() and counts[1] == counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]


def test_clean_documents_stay_and_toxic_ones_go(spark, sf_dir, pipeline):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, table, sf_dir).select("doc_id").collect()}
    terms = re.compile(r"\b(loser|idiot|moron|clown|scum|trash|pathetic|worthless|disgusting|stupid)\b")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    many = [r.doc_id for r in table.collect() if len(terms.findall((r.text or "").lower())) >= 2]
    assert sum(i not in kept for i in many) >= 0.8 * len(many)


def test_empty_table(spark, sf_dir, pipeline):
    empty = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


def test_near_duplicates_link_by_simhash_and_by_shingles(spark, sf_dir, pipeline):
    def tail(c, n):
        return " ".join(f"{c}{i}" for i in range(n))
    phrase = "one two three four five " * 200
    texts = [phrase + tail("a", 40), phrase + tail("b", 40),  # one fingerprint, as repeats weigh; few shingles in common
             tail("c", 60) + " end", tail("c", 60) + " stop",  # one shingle differs, and many bits
             tail("d", 60), None]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    kept = sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, table, sf_dir).select("doc_id").collect())
    assert kept == [0, 2, 4, 5]
