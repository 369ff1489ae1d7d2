"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import chat, chunks, codes, curves, lines, mixing, orc_tokens, passages, pieces, quality, ranking, simhash, toxicity
from salesloom.llm.common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """Where the public merge-type model lies on the driver; it is sent to the executors from there."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer_path() -> str:
    """Where the public byte-level vocabulary lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edited_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


SQL["op6_mixing"] = mixing.MIX_SQL


@_query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


SQL["op7_chat"] = chat.ROTATE_SQL


@_query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=100, k=10)


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the text blocks that their host repeats."""
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of("url").alias("host"), lines.page_text("html").alias("text"))
    pages = written(pages, "pages")  # both passes read the text, which takes many patterns to make
    return lines.drop_frequent_lines(pages, "host", "text", dropped="dropped_lines")


SQL["op9_line_dedup"] = lines.PAGES_SQL


@_query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_texts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), remembered=300_000)


@_query
def op11_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_report(table(spark, sf_dir, "documents"), "doc_id", "text", byte_tokenizer_path())


@_query
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


SQL["op12_codes"] = codes.CODES_SQL


@_query
def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


SQL["op13_ranking"] = ranking.SEARCH_SQL
