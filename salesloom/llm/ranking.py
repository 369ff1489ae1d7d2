"""Ranked lexical search by dense blocked multiplication.

Queries (items) are numbered and taken in blocks of bounded text. A block's terms are its vocabulary, sent to the executors. One
pass over the documents keeps of each its number of terms and its counts of vocabulary terms, as a compact table. From that table
come the number of documents and of terms and each term's document frequency, and so the weights; then every task multiplies
tiles: counts of terms in items (items x vocabulary tile) by impacts of terms in documents (vocabulary tile x documents), as
float64 matrices. All entries are whole numbers, and the vocabulary is cut into tiles so that no sum within a tile can pass
2^53; the products are therefore exact in any order of addition, and tiles add up in 64-bit integers.

A term's weight is floor(1000 ln((2N+2) / (2 df+1))), its impact weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + (25 n N) div L.
A tile keeps what scores at least as much as an item's k-th best document, so ties are decided by ids and never by tiles; each task
sends k rows an item, which meet in two steps.

Rows of documents are documents of their own, also with one id or none (null ids are last among equal scores); rows of items
are items of their own. Null texts have no terms and are not counted. Items and documents without common terms give no row, an
empty table on either side none. Further columns are not read.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm.common import ship, utf8, written
from salesloom.operators.ordering import number_rows, top_k_per_group

K = 20
#: Bytes of item text in a block, items that are counted together, documents in a tile, terms in a tile.
BLOCK_BYTES, CHUNK, TILE_DOCS, TILE_TERMS = 4 << 20, 64, 512, 4096
EXACT = 1 << 53
PARTS = 32
_NO_ID = (1 << 63) - 1
#: Everything but ASCII letters and digits and the bytes of other characters ends a term; A-Z are lower-cased.
_FOLDED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def impact(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def vocabulary_tiles(counts: np.ndarray, weight: np.ndarray, width: int = TILE_TERMS, exact: int = EXACT) -> list[tuple[int, int]]:
    """Ranges of the vocabulary in which no item's sum of count x weight x 10^6, the most an impact can be, reaches `exact`.

    `counts` has the largest count of each term in an item, so a range's sum bounds that of every item."""
    most = [int(c) * max(1, int(w)) * 1_000_000 for c, w in zip(counts, weight)]
    tiles, start, total = [], 0, 0
    for i, x in enumerate(most):
        if i > start and (total + x >= exact or i - start >= width):
            tiles.append((start, i))
            start, total = i, 0
        total += x
    return [*tiles, (start, len(most))] if len(most) else []


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(item number, document number) of each item's k highest scores above 0, ties to smaller ids; scores is items x documents."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        kept = (scores >= least[:, None]) & (scores > 0)
    else:
        kept = scores > 0
    item, doc = np.nonzero(kept)
    order = np.lexsort((ids[doc], -scores[item, doc], item))
    item, doc = item[order], doc[order]
    first = np.searchsorted(item, np.arange(scores.shape[0]))
    cut = np.arange(len(item)) - first[item] < k
    return item[cut], doc[cut]


def _counted(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with terms; `vocabulary` is a broadcast list of terms."""
    kept = docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in batches:
            rows, sizes, flat, counts = [], [], [], []
            edges = [0]
            for row, one in enumerate(batch.column(1)):
                words = terms(one.as_py())
                if not words:
                    continue
                found = np.array([x for x in map(place.get, words) if x is not None], np.int32)
                own, times = np.unique(found, return_counts=True)
                rows.append(row)
                sizes.append(len(words))
                flat.append(own)
                counts.append(times.astype(np.int32))
                edges.append(edges[-1] + len(own))
            at = pa.array(np.array(edges, np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.empty(0, np.int32))) for x in (flat, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return kept.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        own = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # a row for each term of a block
        out[r["term"]] = r["df"]
    return out


def _scored(counted: DataFrame, model, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every item in every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, item_terms, item_counts, tiles, weight, documents, length = model.value
        found = [np.empty(0, np.int64)] * 3
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(start, TILE_DOCS)
                ids = tile.column(0).fill_null(_NO_ID).to_numpy()
                n = tile.column(1).to_numpy()
                sizes = np.diff(tile.column(2).offsets.to_numpy())
                doc = np.repeat(np.arange(len(ids)), sizes)
                term, tf = (tile.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                m = 75 + (25 * n * documents) // length
                value = impact(tf, m[doc], weight[term])
                scores = np.zeros((items, len(ids)), np.int64)
                for low, high in tiles:
                    own = (term >= low) & (term < high)
                    if not own.any():
                        continue
                    used, column = np.unique(term[own], return_inverse=True)  # the part of the tile's vocabulary that the documents have
                    right = np.zeros((len(used), len(ids)))
                    right[column, doc[own]] = value[own]
                    left = np.zeros((items, len(used)))
                    at = np.searchsorted(used, item_terms[1])
                    hit = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == item_terms[1])
                    left[item_terms[0][hit], at[hit]] = item_counts[hit]
                    scores += (left @ right).astype(np.int64)
                item, place = best(scores, ids, k)
                found = [np.concatenate(x) for x in zip(found, (item, ids[place], scores[item, place]))]
            order = np.lexsort((found[1], -found[2], found[0]))
            found = [x[order] for x in found]
            first = np.searchsorted(found[0], np.arange(items))
            kept = np.arange(len(found[0])) - first[found[0]] < k
            found = [x[kept] for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _blocks(numbered: DataFrame, block_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of item numbers with at most `block_bytes` of text, or `CHUNK` items."""
    sizes = numbered.groupBy(F.floor(F.col("number") / CHUNK).alias("chunk")).agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("items"))
    start = stop = total = 0
    for r in sizes.orderBy("chunk").toLocalIterator():  # a row for `CHUNK` items
        if stop > start and total + r["size"] > block_bytes:
            yield start, stop
            start, total = stop, 0
        stop += r["items"]
        total += r["size"]
    if stop > start:
        yield start, stop


def _answers(spark: SparkSession, docs: DataFrame, key: str, text: str, block: list, k: int) -> DataFrame | None:
    """(number, doc_id, score): the k best documents of each item of a block."""
    bags = [Counter(terms(r["text"])) for r in block]
    vocabulary = sorted(set().union(*bags))
    if not vocabulary:
        return None
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = [(i, place[t], c) for i, bag in enumerate(bags) for t, c in bag.items()]
    item_rows, item_terms, item_counts = (np.array(x, np.int64) for x in zip(*rows))
    most = np.zeros(len(vocabulary), np.int64)
    np.maximum.at(most, item_terms, item_counts)

    counted = written(_counted(docs, key, text, spark.sparkContext.broadcast(vocabulary)), "counted")
    documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    weight = weights(_frequencies(counted, len(vocabulary)), documents)
    model = spark.sparkContext.broadcast((len(block), (item_rows, item_terms), item_counts, vocabulary_tiles(most, weight), weight, documents, length))
    own = _scored(counted, model, k).withColumn("part", F.spark_partition_id() % PARTS)
    best_first = [F.col("score").desc(), F.col("doc_id")]
    own = top_k_per_group(own, ["item", "part"], best_first, k).select("item", "doc_id", "score")
    own = top_k_per_group(own, ["item"], best_first, k, "rank")
    first = block[0]["number"]
    return own.select((F.col("item") + first).alias("number"), "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")


def search(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for every item."""
    spark = docs.sparkSession
    ship(spark)
    queries = items.select(F.col(item_key).alias("item_id"), utf8(item_text).alias("text"))
    numbered = written(number_rows(queries, [F.col("item_id").isNull(), F.col("item_id"), F.xxhash64("text")], "number", 0), "items")
    found = []
    for start, stop in _blocks(numbered, block_bytes):
        block = numbered.where((F.col("number") >= start) & (F.col("number") < stop)).select("number", "text").collect()  # bounded by `_blocks`
        answers = _answers(spark, docs, key, text, sorted(block, key=lambda r: r["number"]), k)
        if answers is not None:
            found.append(written(answers, "answers"))
    kind = numbered.schema["item_id"].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole.join(numbered.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


SEARCH_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
i AS (
  SELECT row_number() OVER () AS row_id, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT row_id AS item, item_id, term, count(*) AS c FROM i GROUP BY ALL),
s AS (SELECT count(*)::HUGEINT AS docs, sum(len(words))::HUGEINT AS length FROM d WHERE len(words) > 0),
t AS (SELECT row_id, doc_id, len(words)::HUGEINT AS n, unnest(words) AS term FROM d),
f AS (SELECT row_id, doc_id, n, term, count(*)::HUGEINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
v AS (SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // length)))) AS v FROM f JOIN w USING (term), s),
r AS (SELECT item, item_id, doc_id, row_id, sum(c * v)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY item, item_id, doc_id, row_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
WHERE rank <= {K}
"""
