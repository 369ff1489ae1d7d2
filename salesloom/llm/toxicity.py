"""Toxicity by a classifier chain: categories are predicted one after the other, and the probabilities of earlier
categories are features of the later linear models.

A model that trains on its own predictions for rows it has seen trusts them too much. So the training rows are dealt to
`FOLDS` folds, each category is predicted for a fold by a model that has seen the other folds only, and the next
category trains on these out-of-fold probabilities. A last model of each category trains on all rows and scores.

Features are the different words of a text in lower case and their beginnings of four and six letters, hashed; a word
counts once, so a few insults in a long text weigh as much as in a short one. Training takes at most `SAMPLE` documents
of each label, the first in order of a seeded hash of their id. The models of one category train beside each other in
`FOLDS` + 1 tasks on that bounded sample. All documents are scored, whole, in one pass without a shuffle.

Labels other than 0 and 1 and labels without a document are ignored, of several labels of a document the largest counts,
of several rows with one id one trains. Null and empty texts have no words and are not toxic by intercept alone in any
sound model. Null ids and repeated rows are scored like others. Without labels of both kinds no text is toxic.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salesloom.llm import linear
from salesloom.llm.common import ship, written

SAMPLE, FOLDS, BITS, SEED, THRESHOLD = 4_000, 3, 18, 11, 0.5
WORD = re.compile(r"\w+")
#: Labelled data name toxic documents only. A toxic training document that has one of a category's words (a fixed list)
#: belongs to the category; the last category is the label itself.
CATEGORIES = {
    "insult": ("loser", "idiot", "moron", "clown", "scum", "trash"),
    "contempt": ("pathetic", "worthless", "disgusting", "stupid"),
}
LAST = "toxic"


def training_rows(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, bits: int = BITS, folds: int = FOLDS) -> DataFrame:
    """(key, fold, features, and a column for each category) of at most `sample` documents of each label."""
    ship(df.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    known = known.join(df.select(F.col(key).alias("_have")), F.col("_key") == F.col("_have"), "left_semi")
    parts = [known.where(F.col("_label") == y).orderBy(F.xxhash64(F.lit(SEED), "_key"), "_key").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    texts = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_key"))  # 2 * `sample` rows of two numbers at most
    once = Window.partitionBy("_key").orderBy(F.xxhash64("_text"), F.length("_text"))
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    words = F.lower("_text")
    marks = [(F.col("_label") * words.rlike(rf"\b({'|'.join(terms)})\b").cast("int")).alias(name) for name, terms in CATEGORIES.items()]
    rows = rows.select("_key", "_text", *marks, F.col("_label").alias(LAST))
    names = [*CATEGORIES, LAST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linear.stems(x, WORD, bits) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found, pa.list_(pa.int64())), *[batch.column(n) for n in names]], ["key", "features", *names])

    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, features array<bigint>, " + ", ".join(f"{n} int" for n in names))
    return out.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.lit(folds)).cast("int"))


def train_chain(rows: DataFrame, names: list[str], bits: int = BITS, folds: int = FOLDS) -> list[np.ndarray]:
    """The models in the order of `names`: 2^bits word weights, the intercept, and a weight for each earlier category."""
    rows = written(rows.withColumn("earlier", F.array().cast("array<double>")), "toxicity")
    models = []
    kind = rows.schema["key"].dataType.simpleString()
    for step, name in enumerate(names):
        size = (1 << bits) + 1 + step

        def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
            model = int(group[0])
            part = part.sort_values("key", kind="stable")
            points = [(np.concatenate([f, np.arange(1 << bits, size)]), np.concatenate([np.ones(len(f) + 1), np.asarray(e, float)])) for f, e in zip(part["features"], part["earlier"])]
            seen = (part["fold"] != model).to_numpy()
            y = part[name].to_numpy(float)
            w = linear.fit([p for p, s in zip(points, seen) if s], y[seen], size, alpha=0.5, l1=3.0, l2=0.1, epochs=3)
            if model == folds:
                at = np.nonzero(w)[0]
                return pd.DataFrame({"key": None, "at": at, "value": w[at]})
            other = [(k, float(linear.sigmoid(w[a] @ x))) for k, (a, x), s in zip(part["key"], points, seen) if not s]
            return pd.DataFrame({"key": [k for k, _ in other], "at": [-1] * len(other), "value": [v for _, v in other]})

        dealt = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        out = written(dealt.groupBy("model").applyInPandas(run, f"key {kind}, at bigint, value double"), "toxicity")
        weights = np.zeros(size)
        for r in out.where("at >= 0").select("at", "value").toLocalIterator():  # `size` rows at most
            weights[r["at"]] = r["value"]
        models.append(weights)
        if step + 1 < len(names):
            folded = out.where("at < 0").select(F.col("key").alias("_key"), "value")
            rows = rows.join(folded, F.col("key") == F.col("_key")).withColumn("earlier", F.concat("earlier", F.array("value"))).drop("_key", "value")
            rows = written(rows, "toxicity")
    return models


def score_chain(df: DataFrame, text: str, models: list[np.ndarray], names: list[str], keep: list[Column], bits: int = BITS) -> DataFrame:
    """The columns `keep` and a column of probabilities for each category, for every row."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(models)  # 2 MB a category, whatever the data
    kept = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_words_of"))
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(n, T.DoubleType(), False) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out = np.empty((len(weights), batch.num_rows))
            for i, one in enumerate(batch.column(len(batch.columns) - 1).to_pylist()):
                found = linear.stems(one, WORD, bits)
                for step, w in enumerate(weights):
                    out[step, i] = linear.sigmoid(w[found].sum() + w[1 << bits] + w[(1 << bits) + 1:] @ out[:step, i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, pa.float64()) for x in out]], schema.fieldNames())

    return kept.mapInArrow(run, schema)


def toxicity_models(df: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[np.ndarray], list[str]]:
    names = [*CATEGORIES, LAST]
    return train_chain(training_rows(df, labels, key, text, label), names), names


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, the probability of each category, and rejected, for every row."""
    models, names = toxicity_models(df, labels, key, text, label)
    scored = score_chain(df, text, models, [f"p_{n}" for n in names], [F.col(key).alias("_key")])
    rejected = F.col(f"p_{LAST}") > THRESHOLD  # a model without labels gives 0.5 and rejects nothing
    return scored.select(F.col("_key").alias(key), *[f"p_{n}" for n in names], rejected.alias("rejected"))


def drop_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of df that are not rejected, all columns; scored where they lie, without a join."""
    models, names = toxicity_models(df, labels, key, text, label)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    scored = score_chain(df, text, models, [f"p_{n}" for n in names], [row])
    return scored.where(F.col(f"p_{LAST}") <= THRESHOLD).select("_row.*")
