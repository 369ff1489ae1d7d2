"""Quality classifier: logistic regression over hashed one-word and two-word features, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

Words and runs of other visible characters are tokens, in their own case. A feature's value is its count by the square
root of the number of features. Training takes at most `SAMPLE` labelled documents, the first in order of a seeded hash of
their id, however large the table is; they are dealt to `SHARDS` tasks whose weights are averaged, so a task sees a bounded
number of rows. The model has 2^`BITS` weights at most. All documents are scored, whole, by one pass without a shuffle.

Labels are read from the label table only; rows held out (the remainder of crc32 of the id by 5 is 0) never train. Labels
other than 0 and 1 and labels without a document are ignored; of several labels of a document the largest counts, of
several rows with one id one trains. Null texts count as empty and are scored (the intercept alone); a null id counts as
held out. Repeated rows stay. Without any label every score is 0.5. An empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salesloom.llm import linear
from salesloom.llm.common import ship

SAMPLE, SHARDS, BITS, SEED = 8_000, 4, 18, 7
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")


def fold_of(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample_of(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(key, text, label): at most `sample` labelled documents that are not held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold_of(key) != HELD_OUT)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    # Labels may be without a document; ids of the documents are a narrow column to read.
    known = known.join(df.select(F.col(key).alias("_have")), F.col("_key") == F.col("_have"), "left_semi")
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "_key"), "_key").limit(sample)
    texts = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_key"))  # `sample` rows of two numbers at most
    once = Window.partitionBy("_key").orderBy(F.xxhash64("_text"), F.length("_text"))
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return rows.select(F.col("_key").alias("key"), F.col("_text").alias("text"), F.col("_label").cast("int").alias("label"))


def _features(text: str, bits: int) -> tuple[np.ndarray, float]:
    found = linear.ngrams(text, TOKEN, bits)
    return found, 1.0 / np.sqrt(max(1, len(found)))


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, shards: int = SHARDS, bits: int = BITS) -> np.ndarray:
    """2^bits weights and the intercept."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, wanted = [], []
        for batch in batches:
            for one, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found, scale = _features(one, bits)
                at, count = np.unique(found, return_counts=True)
                rows.append((np.append(at, 1 << bits), np.append(count * scale, 1.0)))
                wanted.append(y)
        if rows:
            w = linear.fit(rows, np.array(wanted, float), (1 << bits) + 1, alpha=0.6, l1=1.0, epochs=3)
            at = np.nonzero(w)[0]
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*w[at], 1.0], pa.float64())], ["at", "weight"])  # -1 counts the shard

    chosen = sample_of(df, labels, key, text, label, sample).repartition(shards, F.pmod(F.xxhash64("key"), F.lit(shards))).sortWithinPartitions(F.xxhash64("key"), "key")
    sums = chosen.mapInArrow(run, "at int, weight double").groupBy("at").agg(F.sum("weight").alias("weight"))
    found = {r["at"]: r["weight"] for r in sums.toLocalIterator()}  # 2^bits + 2 rows at most
    trained = found.pop(-1, 1.0)
    weights = np.zeros((1 << bits) + 1)
    for at in sorted(found):
        weights[at] = found[at] / trained
    return weights


def score(df: DataFrame, text: str, weights: np.ndarray, keep: list[Column]) -> DataFrame:
    """The columns `keep` and `score`, the probability of label 1, for every row."""
    ship(df.sparkSession)
    bits = int(len(weights) - 1).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2 MB, whatever the data
    kept = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            sums = []
            for one in batch.column(len(batch.columns) - 1).to_pylist():
                found, scale = _features(one, bits)
                sums.append(float(w[found].sum()) * scale + float(w[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(linear.sigmoid(np.array(sums, float)), pa.float64())], schema.fieldNames())

    return kept.mapInArrow(run, schema)


def quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted for every row of df."""
    weights = train(df, labels, key, text, label)
    scored = score(df, text, weights, [F.col(key).alias("_key"), (fold_of(key) == HELD_OUT).alias("held_out")])
    return scored.select(F.col("_key").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
