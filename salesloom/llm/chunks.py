"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes is computed at every byte; where its high bits are zero, a chunk may end. Chunking is
normalised: before the wanted size a border needs four more zero bits than after it, which draws sizes together. A border
depends on the bytes just before it, so an insertion moves all that follows without changing its chunks. The fingerprint
is the set of the chunks' digests with their lengths; the likeness of a text to another one is the length of its
chunks that the other one has by the length of all its chunks, a containment between 0 and 1.

Null texts count as empty. An empty text has an empty fingerprint, is contained in any other, and contains only empty
ones. Equal texts have equal fingerprints. Very long texts are hashed in blocks.

The document after each one (by descending id, null ids last, equal ids by the hash of their texts; after the last comes
the first) is found by one range-partitioned sort: every text moves once, compressed. The borders of the ranges come from
a bounded sample of (id, text hash), and the first document of each range is sent to the end of the range before it, so
no other task or table is asked. Rows with equal id and text are equal in every result, whatever their order. An empty
table gives an empty result.
"""

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm.common import ship, utf8

SMALLEST, WANTED, LARGEST = 12, 40, 160
HARD_BITS, EASY_BITS = 8, 4
#: A pseudo-random number for each byte, made by a rule: the first four bytes of the hash of its name.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:4], "little") for b in range(256)], np.uint32)
_BLOCK = 1 << 20
#: Sampled keys per range, and documents that a range should hold; both bound what the driver sees to a part of the ids.
SAMPLED, PER_RANGE, MOST_SAMPLED = 64, 4_000, 2_000_000


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """h(i) = (h(i-1) << 1) + gear(byte i) in 32 bits, at every byte: after 32 steps a byte has left the hash, so the
    sum over the last 32 bytes is built by doubling."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[width:] += h[:-width] << np.uint32(width)
        h = moved
    return h


def borders(text: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    size = len(text)
    if size <= SMALLEST:
        return [size] if size else []
    raw = np.frombuffer(text, np.uint8)
    hard, easy = [], []
    for start in range(0, size, _BLOCK):
        before = max(0, start - 31)
        h = gear_hashes(raw[before:start + _BLOCK])[start - before:]
        at = np.nonzero(h < np.uint32(1 << (32 - EASY_BITS)))[0]
        easy.append(at + start + 1)
        hard.append(at[h[at] < np.uint32(1 << (32 - HARD_BITS))] + start + 1)
    hard, easy = np.concatenate(hard).tolist(), np.concatenate(easy).tolist()
    out, start = [], 0
    while size - start > SMALLEST:
        i = bisect_left(hard, start + SMALLEST)
        end = hard[i] if i < len(hard) else size
        if end >= start + WANTED:
            i = bisect_left(easy, start + WANTED)
            end = min(easy[i] if i < len(easy) else size, start + LARGEST, size)
        out.append(end)
        start = end
    if start < size:
        out.append(size)
    return out


def chunk_set(text: bytes) -> dict[int, int]:
    """Length of each different chunk by its 64-bit digest."""
    import xxhash

    out, start = {}, 0
    for end in borders(text):
        out[xxhash.xxh3_64_intdigest(text[start:end])] = end - start
        start = end
    return out


def pack(chunks: dict[int, int]) -> str:
    """A fingerprint as text: digest and length of its chunks, both hexadecimal, in order of the digests."""
    return " ".join([f"{d:016x}{n:x}" for d, n in sorted(chunks.items())])


def unpack(fingerprint: str) -> dict[int, int]:
    return {int(x[:16], 16): int(x[16:], 16) for x in fingerprint.split()}


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """The share of the own chunks, by length, that the other text has."""
    total = sum(own.values())
    if not total:
        return 1.0
    return sum(n for d, n in own.items() if d in other) / total


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key` and fingerprint of every row; texts do not move."""
    ship(df.sparkSession)
    kept = df.select(key, utf8(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(chunk_set(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [key, "fingerprint"])

    return kept.mapInArrow(run, T.StructType([kept.schema[key], T.StructField("fingerprint", T.StringType(), False)]))


def _cuts(keys: DataFrame, count: int) -> list[tuple]:
    """First keys of all ranges but the first one: keys of the table, taken evenly from a sample of bounded size."""
    ranges = max(1, round(count / PER_RANGE))
    if ranges == 1:
        return []
    share = min(1.0, SAMPLED * ranges / count, MOST_SAMPLED / count)
    sample = sorted({tuple(r) for r in keys.sample(share, seed=5).collect()})
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)} - set(sample[:1])) if sample else []


def _in_ranges(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(part, tail, none, down, hash, key, packed): documents in the range of their key, and behind each range the first
    document of the next one, with tail = 1. The first document of all stands behind the last range."""
    order = [F.col(key).isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(F.col(key).cast("bigint")), F.lit(0)).alias("down"), F.xxhash64(text).alias("hash")]
    keys = df.select(*order)
    first, count = keys.agg(F.min(F.struct("none", "down", "hash")), F.count(F.lit(1))).first()
    cuts = _cuts(keys, count)
    cuts = [c for c in cuts if first is None or c > tuple(first)]
    heads = {c: i for i, c in enumerate(cuts)}
    if first is not None:
        heads[tuple(first)] = len(cuts)
    shared = df.sparkSession.sparkContext.broadcast((cuts, heads))  # a key for each range
    kept = df.select(*order, F.col(key).cast("bigint").alias("key"), utf8(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cuts, own_heads = shared.value
        told = set()  # a head that repeats is sent once by a task
        for batch in batches:
            place = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            part = [bisect_right(own_cuts, k) for k in place]
            at = list(range(len(part)))
            tail = [0] * len(part)
            for i, k in enumerate(place):
                if k in own_heads and k not in told:
                    told.add(k)
                    part.append(own_heads[k])
                    at.append(i)
                    tail.append(1)
            rows = batch.take(pa.array(at, pa.int32()))
            packed = [zlib.compress(x, 1) for x in rows.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tail, pa.int32()), *rows.columns[:4], pa.array(packed, pa.binary())],
                                             ["part", "tail", "none", "down", "hash", "key", "packed"])

    return kept.mapInArrow(run, "part int, tail int, none int, down bigint, hash bigint, key bigint, packed binary"), len(cuts) + 1


def edited_fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """For every document its fingerprint, that of its text with the last half replaced by the beginning of the next
    document, and how much of it the edited text and the next document contain."""
    ship(df.sparkSession)
    rows, ranges = _in_ranges(df, key, text)
    ordered = rows.repartition(ranges, "part").sortWithinPartitions("part", "tail", "none", "down", "hash")

    def compared(held: tuple, after: tuple) -> tuple:
        (id_, own, own_set), (_, following, following_set) = held, after
        half = len(own) // 2
        edited = (own[:len(own) - half] + following[:half]).encode("utf-8", "surrogatepass")
        edited_set = chunk_set(edited)
        return (id_, len(own), hashlib.sha256(edited).hexdigest(), pack(own_set), pack(edited_set), containment(own_set, edited_set), containment(own_set, following_set))

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, None
        for batch in batches:
            out = []
            for own_part, tail, id_, packed in zip(*[batch.column(c).to_pylist() for c in ("part", "tail", "key", "packed")]):
                if tail and (own_part != part or held is None):
                    continue  # the head came from several tasks
                raw = zlib.decompress(packed)
                row = (id_, raw.decode("utf-8", "replace"), chunk_set(raw))
                if own_part == part and held is not None:
                    out.append(compared(held, row))
                part, held = own_part, None if tail else row
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return ordered.mapInArrow(run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
