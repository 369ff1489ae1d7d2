"""Approximate nearest neighbours by shifted space-filling curves.

Every curve has its own random projection to a few dimensions and its own shift; a vector's place on it is its
Hilbert index there, which keeps near points near for most of them, and other shifts serve the others. All curves
are one table, range-partitioned by (curve, index, id) and numbered densely in that order, and cut into blocks of `BLOCK`
neighbouring rows. A query goes to its own block on each curve and to as many blocks on both sides as hold `SHARE` of all
rows. In a block all distances to its queries are exact, in double precision, and only the nearest go on; the results of
all curves merge into the final order. Blocks hold the same number of rows however the vectors lie.

Equal vectors are one point with its smallest ids, as many as an answer can need, so thousands of copies neither fill a
window nor are lost. Projection and scale come from at most `FITTED` vectors, the first in order of a seeded hash; all
vectors are indexed.

How wide a window must be depends on the data. In the given tables vectors point in random directions of 64 dimensions: the
tenth neighbour is at 1.04 where strangers are at 1.41, so no ordering can bring neighbours close together, and a recall of
0.9 takes a constant share of all rows. `SHARE` and `CURVES` are set for that; data of lower dimension allow less.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
the first fitted one, nor rows with a null id. Of rows that repeat an id and vector one counts; an id with several vectors
stands for each. Ties go to the smaller id. Fewer candidates give fewer rows, an empty table none.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import ship, written
from salesloom.operators.ordering import number_rows, top_k_per_group

CURVES, DIMENSIONS, BITS, BLOCK, SHARE, FITTED, SEED = 20, 8, 8, 512, 0.02, 2_000, 17


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points of an integer grid (rows; below 2^bits in each dimension; dimensions x bits <= 64).

    The known transposition: exchange and invert lower bits from the highest bit down, undo the Gray code, interleave.
    """
    x = cells.astype(np.uint32).copy()
    size = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(size):
            set_ = (x[:, d] & bit) != 0
            exchanged = np.where(set_, np.uint32(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(set_, low, exchanged)
            x[:, d] ^= exchanged
    for d in range(1, size):
        x[:, d] ^= x[:, d - 1]
    carry = np.zeros(len(x), np.uint32)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[:, -1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= carry[:, None]
    out = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(size):
            out = (out << np.uint64(1)) | ((x[:, d] >> np.uint32(level)) & np.uint32(1)).astype(np.uint64)
    return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & sound & F.exists("vector", lambda x: x != 0))


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance): the k nearest rows of each query, ties to smaller ids."""
    rough = (queries ** 2).sum(1)[:, None] + (rows ** 2).sum(1)[None, :] - 2.0 * queries @ rows.T
    scale = 1e-9 * (1.0 + np.abs(rough).max(initial=0.0) + (rows ** 2).sum(1).max(initial=0.0))
    bound = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
    q, r = np.nonzero(rough <= bound[:, None] + scale)
    exact = np.sqrt(((queries[q] - rows[r]) ** 2).sum(1))
    order = np.lexsort((ids[r], exact, q))
    q, r, exact = q[order], r[order], exact[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - first[q] < k
    return q[kept], ids[r[kept]], exact[kept]


def search(df: DataFrame, key: str, vector: str, every: int, k: int, curves: int = CURVES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, key, vector)
    fitted = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(FITTED).collect()  # FITTED vectors
    length = len(fitted[0]["vector"]) if fitted else 0
    sample = np.array([r["vector"] for r in fitted if len(r["vector"]) == length], float).reshape(-1, max(1, length))
    rows = rows.where(F.size("vector") == length)

    # One point for all copies of a vector, with k + 1 ids: a query is one of them and asks for k others.
    copies = top_k_per_group(rows.distinct(), ["vector"], [F.col("id")], k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = written(copies.select(F.element_at("ids", 1).alias("point"), "ids", "vector"), "points")
    asked = rows.where(F.col("id") % every == 0).distinct().join(points.select("vector", "point"), "vector").select(F.col("id").alias("query_id"), F.col("point").alias("asking"))
    asked = written(asked, "asked")

    size = min(DIMENSIONS, max(1, length))
    rng = np.random.default_rng(SEED)
    center = sample.mean(0) if len(sample) else np.zeros(max(1, length))
    spread = float((sample - center).std()) if len(sample) else 1.0
    bases = [np.linalg.qr(rng.normal(size=(len(center), len(center))))[0][:size] for _ in range(curves)]
    shifts = [rng.uniform(-0.1, 0.1, size) for _ in range(curves)]
    shared = spark.sparkContext.broadcast((center, spread or 1.0, bases, shifts))  # a small matrix for each curve

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, unit, turns, moves = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0)
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) - middle
            for c, (turn, move) in enumerate(zip(turns, moves)):
                cells = np.clip(((x @ turn.T) / (8 * unit) + 0.5 + move) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)
                index = (hilbert(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the same order
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(index), own], ["curve", "index", "point"])

    keys = points.select("point", "vector").mapInArrow(place, "curve int, index bigint, point bigint")
    placed = number_rows(keys, ["curve", "index", "point"], "position", 0).select("point", F.floor(F.col("position") / block).alias("block"))
    placed = written(placed, "placed")
    side = int(np.ceil(share * points.count() / block))
    around = asked.select(F.col("asking").alias("point")).distinct().join(placed, "point")
    around = around.select("point", F.explode(F.sequence(F.col("block") - max(1, side), F.col("block") + max(1, side))).alias("block")).distinct()
    dealt = placed.withColumn("asks", F.lit(False)).unionAll(around.withColumn("asks", F.lit(True))).join(points.select("point", "vector"), "point")

    def near(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["point", "asks"])  # the end of one curve and the start of the next may share a block
        asks = part["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"asking": [], "point": [], "score": []})
        all_rows = np.stack(part["vector"].to_numpy())
        ids = part["point"].to_numpy()
        q, found, score = _nearest(all_rows[asks], all_rows[~asks], ids[~asks], k + 1)
        return pd.DataFrame({"asking": ids[asks][q], "point": found, "score": score})

    found = dealt.groupBy("block").applyInPandas(near, "asking bigint, point bigint, score double").distinct()
    best = top_k_per_group(found, ["asking"], [F.col("score"), F.col("point")], k + 1)
    answers = best.select("asking", "point", "score").join(points.select("point", "ids"), "point").select("asking", "score", F.explode("ids").alias("vec_id"))
    own = asked.join(answers, "asking").where("query_id != vec_id")
    return top_k_per_group(own, ["query_id"], [F.col("score"), F.col("vec_id")], k, "rank").select("query_id", F.col("rank").cast("int"), "vec_id", "score")
