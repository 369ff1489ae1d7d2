"""Near copies by the Jaccard similarity of five-word shingles, 0.8 or more.

Texts are lower-cased in A-Z and cut into words at space and the control characters 9 to 13. A text of one to four words
has itself as its only shingle; texts without words, null ones too, are copies of each other.

Search: `BANDS` keys of each text, each made of the least hashes of its shingles under `ROWS` functions. A pair of
similarity s shares a function's least hash with probability s, so it shares a key with probability
1 - (1 - s^ROWS)^BANDS: over 0.99999 at 0.8. Every pair that shares a key is compared on the shingles themselves, unless
other links join the two already, so components are those of all these pairs.

In keys of up to `CROWD` texts all pairs are compared. In others each text is compared with the most central one, which is the
one whose keys have the most members in all: the original of many edited copies shares more keys with them than they do with
each other. Where that leaves a key in more than one component, the texts outside of its largest one meet all texts of the key in
blocks of `BLOCK_TEXTS` by as many: a block holds sketches and texts, compares what is in different components and likely by
the sketches, the likeliest first, and leaves out what its own findings have joined already. No pair is ever a row, and a crowd in
one component but for a few texts sends each of its texts once. A crowd of texts that are all alike but under 0.8 takes all pairs.

Before texts are sent for a comparison, sketches are: the lowest byte of each of the `ROWS` x `BANDS` least hashes. A pair of
similarity 0.8 agrees on 80 % of them with a standard deviation of 3.3 %; pairs that agree on less than `SKETCHED` are no near
copies (five and a half deviations), and their texts stay where they are.

Links found by another method (`linked`, of `text_identity`) join components too, beside those found here.

Copies are one text by the 64-bit hash and length of the text. Rows without an id, repeated rows and ties are as in
`simhash.drop_near_duplicates`. An empty table gives an empty result.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm.common import ship, utf8, written
from salesloom.llm.components import components
from salesloom.llm.passages import KEY_BITS, _identity, _key_bitmap, shingles
from salesloom.llm.simhash import first_rows

ROWS, BANDS, CROWD, BLOCK_TEXTS = 5, 30, 16, 256
#: Similarity from which texts are near copies, as a fraction, and the share of equal sketch bytes below which they can't be.
SIMILAR, SKETCHED = (4, 5), 0.62
_U = np.uint64
_BLOCK = 1 << 10
_FACTORS = (np.random.default_rng(8).integers(0, 1 << 63, ROWS * BANDS, dtype=_U) * _U(2) + _U(1))[:, None]  # odd ones permute 64 bits


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's shingles in order; one for a text of less than five words."""
    import xxhash

    found = shingles(text)
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().split()))], _U)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hash of a text under each function."""
    least = np.full(len(_FACTORS), ~_U(0))
    for start in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[None, start:start + _BLOCK] * _FACTORS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The keys of a text, one for each band."""
    out = np.arange(BANDS, dtype=_U)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _U(0x9FB21C651E98DF25)
        out ^= out >> _U(29)
    return out.view(np.int64)


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have a Jaccard similarity of 0.8 or more."""
    if min(len(x), len(y)) * SIMILAR[1] < max(len(x), len(y)) * SIMILAR[0]:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * SIMILAR[1] >= (len(both) - common) * SIMILAR[0]


def signatures(df: DataFrame, text: str, row: Column) -> DataFrame:
    """(row, doc, keys, sketch) for every row."""
    ship(df.sparkSession)
    kept = df.select(row.alias("row"), _identity(text).alias("doc"), utf8(text).alias("text"))
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [least_hashes(shingle_hashes(x)) for x in batch.column(2).to_pylist()]
            keys = [band_keys(x) for x in least]
            # products by odd factors keep the lowest bits of the shingle, so the sketch is taken from mixed ones
            sketches = pa.array([((x >> _U(23)) & _U(255)).astype(np.uint8).tobytes() for x in least], pa.binary())
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, sketches], ["row", "doc", "keys", "sketch"])

    return kept.mapInArrow(run, schema)


def _texts(df: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    """(doc, packed) of the given texts: a bitmap of fixed size keeps nearly all others from being sent."""
    bitmap = _key_bitmap(docs.select(F.col("doc").alias("key")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            slot = batch.column(0).to_numpy() & ((1 << KEY_BITS) - 1)
            kept = batch.take(pa.array(np.nonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)[0]))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([zlib.compress(x, 1) for x in kept.column(1).to_pylist()], pa.binary())], ["doc", "packed"])

    sent = df.select(_identity(text).alias("doc"), utf8(text).alias("t")).mapInArrow(packed, "doc bigint, packed binary")
    return written(sent.groupBy("doc").agg(F.min("packed").alias("packed")).join(docs, "doc", "left_semi"), "texts")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be near copies by their sketches."""
    met = pairs.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            kept = pa.array((x == y).mean(axis=1) >= SKETCHED) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of near copies among the given ones."""
    pairs = written(_likely(pairs, sketches), "likely")
    met = pairs.join(texts.select(F.col("doc").alias("a"), F.col("packed").alias("text_a")), "a").join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("text_b")), "b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # the text of a side often stands in further rows

        def shingle_set(doc: int, raw: bytes) -> np.ndarray:
            if doc not in known:
                if len(known) >= 64:
                    known.clear()
                known[doc] = np.unique(shingle_hashes(zlib.decompress(raw)))
            return known[doc]

        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            kept = pa.array([near(shingle_set(a[i], x[i]), shingle_set(b[i], y[i])) for i in range(len(a))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return met.mapInArrow(checked, "a bigint, b bigint")


def _in_blocks(crowd: DataFrame, roots: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of near copies that join all the crowd's members of one key that are near copies and not joined by `roots` yet."""
    placed = crowd.join(roots, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", F.coalesce("root", "doc").alias("root"))
    placed = written(placed, "placed")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all")).where("all > most.size")
    open_ = placed.join(largest, "key").select("key", "doc", "root", (F.col("root") != F.col("most.root")).alias("outside"),
                                               F.ceil((F.col("all") - F.col("most.size")) / BLOCK_TEXTS).alias("left"), F.ceil(F.col("all") / BLOCK_TEXTS).alias("right"))
    i, j = F.pmod(F.xxhash64("doc"), F.col("left")), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("right"))
    asking = open_.where("outside").select("key", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("j"), "doc", "root", F.lit(True).alias("asks"), "outside")
    asked = open_.select("key", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), j.alias("j"), "doc", "root", F.lit(False).alias("asks"), "outside")
    held = asking.unionByName(asked).join(sketches, "doc").join(texts, "doc")

    def meet(part: pa.Table) -> pa.Table:
        asks, doc, root, outside = (part.column(c).to_numpy() for c in ("asks", "doc", "root", "outside"))
        x, y = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(part.num_rows, -1)
        alike = np.stack([(sketch[k][None, :] == sketch[y]).mean(axis=1) for k in x])
        wanted = (alike >= SKETCHED) & (root[x][:, None] != root[y][None, :]) & (~outside[y][None, :] | (doc[x][:, None] < doc[y][None, :]))
        p, q = np.nonzero(wanted)
        order = np.argsort(-alike[p, q], kind="stable")
        parent: dict[int, int] = {}

        def top(node: int) -> int:
            while parent.get(node, node) != node:
                node = parent[node]
            return node
        sets: dict[int, np.ndarray] = {}
        packed = part.column("packed")

        def shingle_set(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingle_hashes(zlib.decompress(packed[k].as_py())))
            return sets[k]
        out = []
        for k, l in zip(x[p[order]].tolist(), y[q[order]].tolist()):
            u, v = top(root[k]), top(root[l])
            if u != v and near(shingle_set(k), shingle_set(l)):
                parent[u] = v
                out.append((min(doc[k], doc[l]), max(doc[k], doc[l])))
        a, b = zip(*out) if out else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return held.groupBy("key", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def _pairs(leaders: DataFrame, members: DataFrame, met: str) -> DataFrame:
    """Different pairs (a, b), a < b, of leaders and members of one key."""
    a, b = leaders.select("key", *[F.col(c).alias(f"l_{c}") for c in leaders.columns if c != "key"]), members
    found = a.join(b, "key").where(met)
    return found.select(F.least("l_doc", "doc").alias("a"), F.greatest("l_doc", "doc").alias("b")).distinct()


def text_identity(text: str) -> Column:
    """The number that tells a text of a row in links."""
    return _identity(text)


def roots_of(df: DataFrame, text: str, each: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of the texts that are linked to another one, here or by `linked`; `each` has (doc, keys, sketch) of all different texts."""
    keys = each.select("doc", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared, "key").select("key", "doc", "n"), "members")
    sketches = written(each.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", "sketch"), "sketches")
    texts = _texts(df, text, members.select("doc").distinct())
    few, crowd = members.where(f"n <= {CROWD}").select("key", "doc"), members.where(f"n > {CROWD}")
    weights = crowd.groupBy("doc").agg(F.sum("n").alias("weight"))
    centers = crowd.join(weights, "doc").groupBy("key").agg(F.max(F.struct("weight", "doc")).alias("center")).select("key", F.col("center.doc").alias("first"))
    stars = crowd.join(centers, "key").where("doc <> first").select(F.least("doc", "first").alias("a"), F.greatest("doc", "first").alias("b"))
    links = written(_verified(_pairs(few, few, "l_doc < doc").unionAll(stars).distinct(), sketches, texts), "near")
    if linked is not None:
        links = links.unionByName(linked.select("a", "b"))
    if crowd.isEmpty():
        return components(links)
    more = written(_in_blocks(crowd, components(links), sketches, texts), "near")
    return components(links.unionAll(more))


def drop_near_copies(df: DataFrame, key: str, text: str, linked: DataFrame | None = None) -> DataFrame:
    """One row of each component, all columns: that of the smallest key (nulls last), then of the smallest hash of its text.

    `linked` (a, b) are further links between texts by `text_identity`."""
    row = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    signed = written(signatures(df, text, row), "signatures")
    each = written(signed.groupBy("doc").agg(F.min("row").alias("row"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch")), "texts")
    roots = roots_of(df, text, each.select("doc", "keys", "sketch"), linked)
    known = each.select("doc", "row").join(roots, F.col("doc") == F.col("node"), "left")
    firsts = known.groupBy(F.coalesce("root", "doc").alias("component")).agg(F.min("row").alias("first")).select("first.*")
    return first_rows(df, key, text, firsts)
