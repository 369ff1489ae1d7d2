"""Near duplicates by 64-bit fingerprints of three-word shingles that differ in two bits or fewer.

Fingerprint: texts are lower-cased in A-Z and cut into words at space and the control characters 9 to 13; every run of
three words, repeats included, is hashed with XXH64; a bit is set if more than half of the hashes have it.

Search: a fingerprint is cut into three segments of 22, 21 and 21 bits. Two bits of difference leave at least one
segment equal, and the segment after it has two errors at most. That one is looked up by codewords of the perfect
binary Golay code of length 23: its keys are the codewords nearest to it and to each word at distance one. Two words at
distance two or less have a word at distance one or less of both, so they share a key; a word has one key or six. The
join key is (place, equal segment, codeword), about 16 keys of 34 bits for each different fingerprint, so chance
meetings stay rare however many there are, and candidates are verified by counting the bits that differ.

A key with more than `CROWD` fingerprints (many slightly different copies) would have that many squared pairs. There the
same links are made exactly in another way: two fingerprints are linked if and only if they share a word at distance one
or less, so each is linked to the smallest fingerprint that shares one of its 65 such words.

Texts without words have fingerprint zero and link like any other. Null texts count as empty. Null ids keep their rows;
a component of null ids alone has a null id. Repeated rows and ties stay as rows. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salesloom.llm.common import fresh, ship, utf8, written
from salesloom.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Fingerprints of a key up to which its pairs are compared one by one.
CROWD = 16
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
_BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Fingerprint of a UTF-8 text, unsigned."""
    import xxhash

    words = text.lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles = iter(words)
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    total, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _BLOCK):
        size = min(_BLOCK, total - start)
        hashes = np.fromiter((digest(x, SEED) for _, x in zip(range(size), shingles)), "<u8", size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str | Column, keep: list[Column]) -> DataFrame:
    """The columns `keep` and `fingerprint`, as a signed 64-bit number, for every row."""
    ship(df.sparkSession)
    kept = df.select(*keep, utf8(text).alias("_text"))
    fields = kept.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(len(fields)).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], schema.fieldNames())

    return kept.mapInArrow(run, schema)


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    out = values.copy()
    for bit in range(22, 10, -1):
        out ^= ((out >> bit) & 1) * (GOLAY << (bit - 11))
    return out


def _corrections() -> np.ndarray:
    """The error of weight three or less for each syndrome; the code is perfect, so there is exactly one."""
    ones = 1 << np.arange(23, dtype=np.int64)
    two = [a | b for i, a in enumerate(ones) for b in ones[:i]]
    three = [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    errors = np.array([0, *ones, *two, *three], np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndromes(errors)] = errors
    return table


def golay_keys(values: np.ndarray, width: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of all different codewords nearest to each value or to a value one bit (of `width`) away."""
    table = _corrections() if table is None else table
    around = values[:, None] ^ np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])[None, :]
    index = (around ^ table[_syndromes(around)]) >> 11  # any 12 neighbouring bits tell a codeword of a cyclic code
    index.sort(axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    return np.nonzero(new)[0], index[new]


def search_keys(prints: DataFrame) -> DataFrame:
    """(key, fingerprint) for a table of different fingerprints."""
    ship(prints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _corrections()
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            bits = own.astype("<i8").view("<u8")
            parts = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            for place in range(3):
                other = (place + 1) % 3
                row, code = golay_keys(parts[other], SEGMENTS[other][1], table)
                key = (place << 34) | (parts[place][row] << 12) | code
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "fingerprint"])

    return prints.select("fingerprint").mapInArrow(run, "key bigint, fingerprint bigint")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b: links of different fingerprints; in crowded keys as many as join what is linked, else all."""
    keys = search_keys(prints)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared, "key"), "keys")
    few = members.where(f"n <= {CROWD}").select("key", "fingerprint")
    pairs = (
        few.select("key", F.col("fingerprint").alias("a")).join(few.select("key", F.col("fingerprint").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    )
    crowd = members.where(f"n > {CROWD}").select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(x - (1 << 64) if x >> 63 else x) for x in (1 << i for i in range(64))])
    near = crowd.select("fingerprint", F.explode(flips).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("word"))
    least = near.groupBy("word").agg(F.min("fingerprint").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = near.join(least, "word").where("a < fingerprint").select("a", F.col("fingerprint").alias("b"))
    return pairs.unionAll(stars).distinct()


def classes(prints: DataFrame, first: Column) -> DataFrame:
    """(fingerprint, component, first): its component's smallest fingerprint and the smallest `first` among its rows."""
    each = written(prints.groupBy("fingerprint").agg(F.min(first).alias("first")), "prints")
    roots = components(links(each))
    known = each.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("component"), "first")
    known = written(known, "classes")
    firsts = known.groupBy("component").agg(F.min("first").alias("first"))
    return known.drop("first").join(firsts, "component")


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, fingerprint (16 hexadecimal digits) and component_id, the smallest key reachable over links, for every row."""
    prints = written(fingerprints(df, text, [F.col(key).alias("_key")]), "fingerprints")
    known = classes(prints, F.col("_key"))
    return prints.join(known, "fingerprint").select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def text_links(df: DataFrame, text: str, doc: Column) -> DataFrame:
    """(a, b): every `doc`, a number that tells the text of a row, beside the smallest one of its component, if that is another."""
    prints = written(fingerprints(df, text, [doc.alias("doc")]).distinct(), "fingerprints")
    return prints.join(classes(prints, F.col("doc")), "fingerprint").where("first < doc").select(F.col("first").alias("a"), F.col("doc").alias("b"))


def drop_near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each component, all columns: that of the smallest key (nulls last), then of the smallest hash of its text.

    Rows that repeat both are one document; the first of them by the other columns stays.
    """
    row = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    prints = written(fingerprints(df, text, [row.alias("_row")]), "fingerprints")
    known = classes(prints, F.col("_row"))
    return first_rows(df, key, text, known.select("first.*").distinct())


def first_rows(df: DataFrame, key: str, text: str, firsts: DataFrame) -> DataFrame:
    """One row of df for each (key, hash of the text) in `firsts`, all columns."""
    hashed = fresh(df, "_hash")
    rows = df.withColumn(hashed, F.xxhash64(text))
    kept = rows.join(firsts, rows[key].eqNullSafe(firsts["key"]) & (rows[hashed] == firsts["hash"]), "left_semi")
    place = fresh(df, "_place")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (key, text)]
    same = Window.partitionBy(key, hashed).orderBy(*(others or [F.lit(1)]))
    return kept.withColumn(place, F.row_number().over(same)).where(f"{place} = 1").drop(place, hashed)
