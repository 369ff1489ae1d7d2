"""A training-data pipeline over documents: toxicity, line and near-duplicate removal, mixing, tokens."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import lines, minhash, mixing, pieces, simhash, toxicity
from salesloom.llm.common import table, written
from salesloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject; it trains on the labelled ones among those given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars counts what is left.

    A source is broader than a host: its boilerplate is on over 1 % and at least 10 of its documents with different other lines."""
    kept = lines.drop_frequent_lines(docs, "source", "text", lines.SOURCE_RATIO, lines.SOURCE_PAGES, different=True)
    return kept.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked also over others.

    Texts link by SimHash, as in op2_simhash: fingerprints that differ in two bits or fewer. Near copies of Jaccard similarity 0.8 or
    more over five-word shingles mostly differ in more bits, so a second step links these as well; both make the groups."""
    linked = written(simhash.text_links(docs, "text", minhash.text_identity("text")), "linked")
    return minhash.drop_near_copies(docs, "doc_id", "text", linked)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs, "doc_id", "text", "source")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hash of the ids of every document of the mix, and hash of what they decode to."""
    return pieces.digest_texts(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokens),
]

#: The first stage is a trained model; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what the stages before it return is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
