"""Vector codes: product quantisation by member-resident Lloyd rounds.

Vectors become whole numbers and are cut into equal consecutive parts. Every part is a member of one entry of its position's
codebook and lives in the partition of (position, entry, salt), its owner. In a round owners find the nearest entry of each
resident member (codebooks are a few small arrays, sent to all). Members that keep their entry stay where they are; only those
that change it are dealt to their new owners, and the union of both has the same partitioner, so the shuffle carries nothing
else. Owners then sum their residents; the sums of an entry meet, and its new value is the mean. Sums are whole numbers, so the
result doesn't depend on order or partitions. This takes partitioned collections of numpy blocks, which DataFrames can't keep in
place over rounds; members are read from and their codes returned to DataFrames. Every third
round is a reliable checkpoint.

Salts come from a row's place, one for `SALTED` rows in a row, and are no fewer than partitions. Owners are dealt out so that every
(position, entry) goes on over all partitions by salt: an entry or a vector with a third of all rows is as even as any other.

Rows whose vector is null or holds null or non-finite components are dropped. The vector of the smallest id (of several, the
smallest) gives the length; rows of another length are dropped, and a length that the parts don't divide is filled up with
zeros. Components beyond +-2^`_bound` bits, where squared distances could pass 64 bits, count as that bound. Codebooks start from
the parts of the smallest ids, one vector for each id; with fewer ids there are fewer entries. Null ids are coded but start no
entry; without any id there is no codebook and no row. Rows that repeat are rows of their own. label_error is null where a sum
passes 64 bits. An empty table gives an empty result.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import reliable, shared_folder, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block, and members that a partition should have.
BLOCK, PER_PARTITION = 4096, 400_000
#: Rows that share a salt, and the least number of salts.
SALTED, SALTS = 256, 1024
CHECKPOINT_EVERY = 3
_Books = list[np.ndarray]  # for each position entries x width


def _bound(length: int) -> int:
    return math.isqrt((1 << 62) // max(1, length)) // 2


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of rows of components."""
    most = _bound(vectors.shape[1])
    return np.clip(np.floor(vectors.astype(float) * scale), -most, most).astype(np.int64)


def cut(numbers: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width, filled up with zeros."""
    width = -(-numbers.shape[1] // parts)
    filled = np.zeros((len(numbers), parts * width), np.int64)
    filled[:, :numbers.shape[1]] = numbers
    return filled.reshape(len(numbers), parts, width)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower one, and its squared distance."""
    far = np.zeros((len(rows), len(book)), np.int64)
    for d in range(rows.shape[1]):
        step = rows[:, d, None] - book[None, :, d]
        far += step * step
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(rows)), entry]


def _by_entry(position: int, entry: np.ndarray, rows: np.ndarray, parts: np.ndarray, owners: int) -> Iterator[tuple[tuple[int, int, int], tuple[np.ndarray, np.ndarray]]]:
    """Blocks of members by owner: (position, entry, salt)."""
    salt = (rows // SALTED + (rows >> 33) * 37) % max(SALTS, owners)  # the upper bits count the partitions of the input
    order = np.lexsort((rows, salt, entry))
    own = np.stack([entry[order], salt[order]], axis=1)
    edges = np.nonzero(np.any(np.diff(own, axis=0, prepend=own[:1] - 1) != 0, axis=1))[0]
    for low, high in zip(edges, [*edges[1:], len(order)]):
        at = order[low:high]
        yield (position, int(own[low, 0]), int(own[low, 1])), (rows[at], parts[at])


def _gathered(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """The same members in blocks of about `BLOCK` rows by owner; no more is held than a partition has."""
    held: dict[tuple, list] = {}
    sizes: dict[tuple, int] = {}
    for key, block in blocks:
        held.setdefault(key, []).append(block)
        sizes[key] = sizes.get(key, 0) + len(block[0])
        if sizes[key] >= BLOCK:
            sizes.pop(key)
            yield key, tuple(np.concatenate(x) for x in zip(*held.pop(key)))
    for key, some in held.items():
        yield key, tuple(np.concatenate(x) for x in zip(*some))


class Lloyd:
    """Members in their owners' partitions, and the codebooks."""

    def __init__(self, members: RDD, books: _Books, owners: int, entries: int):
        self.books, self.owners = books, owners
        self.context, self.turn, self.earlier = members.context, 0, []
        # Every (position, entry) starts at another partition and goes on by salt, so all of them are spread evenly.
        self.deal = lambda key: (key[0] * entries + key[1]) + key[2]
        self.residents = self._settled(members.partitionBy(owners, self.deal))

    def _settled(self, members: RDD) -> RDD:
        """Kept by the executors; every few rounds the next job also writes a checkpoint, so that lost ones repeat little."""
        members = members.persist(StorageLevel.MEMORY_AND_DISK)
        if self.turn % CHECKPOINT_EVERY == 0:
            members.checkpoint()
        self.turn += 1
        return members

    def migrate(self) -> RDD:
        """Give every member its nearest entry, once the residents are asked for; the blocks of those that change it and are dealt anew."""
        owners, books = self.owners, self.context.broadcast(self.books)

        def placed(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for (position, old, salt), (rows, parts) in _gathered(blocks):
                entry, _ = nearest(parts, books.value[position])
                stay = entry == old
                if stay.any():
                    yield True, ((position, old, salt), (rows[stay], parts[stay]))
                if not stay.all():
                    for block in _by_entry(position, entry[~stay], rows[~stay], parts[~stay], owners):
                        yield False, block

        step = self.residents.mapPartitions(placed, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        staying = step.mapPartitions(lambda x: (b for stays, b in x if stays), preservesPartitioning=True)
        leaving = step.mapPartitions(lambda x: (b for stays, b in x if not stays))
        self.earlier += [step, self.residents]
        self.residents = self._settled(staying.union(leaving.partitionBy(owners, self.deal)))
        return leaving

    def update(self) -> None:
        """Every entry becomes the mean of its members, rounded down; unused entries stay."""
        def sums(blocks: Iterator[tuple]) -> Iterator[tuple]:
            total: dict[tuple[int, int], list] = {}
            for (position, entry, _), (rows, parts) in blocks:
                own = total.setdefault((position, entry), [0, [0] * parts.shape[1]])
                own[0] += len(rows)
                own[1] = [a + int(b) for a, b in zip(own[1], parts.sum(axis=0))]
            yield from total.items()

        # A row for each entry of each position; Python's integers don't overflow.
        for (position, entry), (count, total) in self.residents.mapPartitions(sums).reduceByKey(lambda a, b: [a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]]).collect():
            self.books[position][entry] = [x // count for x in total]
        while self.earlier:  # the new residents are kept now
            self.earlier.pop().unpersist()


def _members(rows: DataFrame, length: int, parts: int, books: _Books, owners: int) -> RDD:
    """Blocks of members by the nearest first entry."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()), pa.array([np.ascontiguousarray(whole(flat)).tobytes()], pa.binary())], ["rows", "numbers"])

    def dealt(blocks: Iterator) -> Iterator[tuple]:
        for r in blocks:
            own = np.frombuffer(r["rows"], np.int64)
            split = cut(np.frombuffer(r["numbers"], np.int64).reshape(len(own), length), parts)
            for position in range(parts):
                entry, _ = nearest(split[:, position], shared.value[position])
                yield from _by_entry(position, entry, own, split[:, position], owners)

    return rows.select("row", "vector").mapInArrow(run, "rows binary, numbers binary").rdd.mapPartitions(dealt)


def fingerprint(books: _Books) -> str:
    """Hash of all components in decimal, by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def train(df: DataFrame, key: str, vector: str, carried: list[str], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          per_partition: int = PER_PARTITION, watched: list[int] | None = None) -> tuple[DataFrame, _Books]:
    """(row, key, carried columns, code, error) of the kept rows, and the codebooks.

    `code` is an array of entries; `entries` is at most 256. `watched` gets the number of members that move in each round."""
    spark = df.sparkSession
    ship(spark)
    shared_folder(spark)
    values = F.col(f"`{vector}`").cast("array<double>")
    sound = values.isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(sound).select(F.col(f"`{key}`").cast("bigint").alias("_id"), values.alias("vector"), *[F.col(f"`{c}`").alias(f"_of_{c}") for c in carried])
    firsts = kept.where("_id IS NOT NULL").groupBy("_id").agg(F.min("vector").alias("vector")).orderBy("_id").limit(entries).collect()  # `entries` vectors
    length = len(firsts[0]["vector"]) if firsts else 0
    starts = [r["vector"] for r in firsts if len(r["vector"]) == length]
    first = np.array(starts, float).reshape(len(starts), length)
    books = [x.copy() for x in cut(whole(first), parts).transpose(1, 0, 2)]
    kept = kept.where((F.size("vector") == length) & F.lit(bool(firsts))).withColumn("row", F.monotonically_increasing_id())
    rows = reliable(kept)  # the row numbers stay
    owners = max(1, -(-rows.count() * parts // per_partition), min(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))

    if not firsts:
        members = spark.sparkContext.emptyRDD()
    else:
        lloyd = Lloyd(_members(rows, length, parts, books, owners), books, owners, entries)
        for turn in range(rounds):
            if turn:
                leaving = lloyd.migrate()
                if watched is not None:
                    watched.append(leaving.map(lambda b: len(b[1][0])).sum())
            lloyd.update()
        members, books = lloyd.residents, lloyd.books
    last = spark.sparkContext.broadcast(books)

    def coded(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for (position, _, _), (own, block) in _gathered(blocks):
            entry, far = nearest(block, last.value[position])
            yield bytearray(own.tobytes()), position, bytearray(entry.astype(np.int64).tobytes()), bytearray(far.tobytes())

    packed = spark.createDataFrame(members.mapPartitions(coded), "rows binary, position int, entries binary, far binary")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, position, entry, far in zip(*[x.to_pylist() for x in batch.columns]):
                own = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), position, np.int32)), pa.array(np.frombuffer(entry, np.int64).astype(np.int32)), pa.array(np.frombuffer(far, np.int64))], ["row", "position", "entry", "far"])

    codes = packed.mapInArrow(flat, "row bigint, position int, entry int, far bigint").groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]).alias("code"), F.sum("far").alias("error"))  # `parts` rows each
    named = rows.select("row", F.col("_id").alias(key), *[F.col(f"_of_{c}").alias(c) for c in carried])
    return named.join(codes, "row"), books


def code_report(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = train(df, key, vector, [label])
    coded = reliable(coded)
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    digits = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    met = coded.join(sums, F.col(label).eqNullSafe(F.col("_label")))
    return met.select(key, digits.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The rounds one by one; vectors of one length that the parts divide."""
    steps = [f"""
k AS (SELECT row_number() OVER () AS row_id, vec_id, label, embedding AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT row_id, vec_id, label, list_transform(v, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM k),
p AS MATERIALIZED (SELECT row_id, vec_id, part, list_slice(v, part * (len(v) // {PARTS}) + 1, (part + 1) * (len(v) // {PARTS})) AS x FROM n, range({PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {ENTRIES})"""]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for turn in range(ROUNDS + 1):
        steps.append(f"a{turn} AS MATERIALIZED (SELECT row_id, p.part, min(struct_pack(far := {far}::BIGINT, entry := entry)) AS best FROM p JOIN b{turn} b ON p.part = b.part GROUP BY row_id, p.part)")
        if turn < ROUNDS:
            steps.append(f"""m{turn} AS (
  SELECT part, entry, list(mean ORDER BY i) AS c FROM (
    SELECT part, entry, i, floor(0)::BIGINT + (sum(x)::HUGEINT - (((sum(x)::HUGEINT % count(*)) + count(*)) % count(*))) // count(*) AS mean FROM (
      SELECT a.part, a.best.entry AS entry, unnest(range(len(p.x))) AS i, unnest(p.x) AS x FROM a{turn} a JOIN p ON a.row_id = p.row_id AND a.part = p.part)
    GROUP BY part, entry, i) GROUP BY part, entry)""")
            steps.append(f"b{turn + 1} AS MATERIALIZED (SELECT b.part, b.entry, list_transform(coalesce(m.c, b.c), lambda x: x::BIGINT) AS c FROM b{turn} b LEFT JOIN m{turn} m ON b.part = m.part AND b.entry = m.entry)")
    return "WITH" + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
r AS (SELECT row_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM a{ROUNDS} GROUP BY row_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM n JOIN r USING (row_id), h
"""


CODES_SQL = _codes_sql()
