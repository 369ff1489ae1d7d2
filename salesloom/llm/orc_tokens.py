"""Token ids of documents as ORC files.

Documents are range-partitioned by id and sorted, encoded in that order, and written as ORC by the same tasks: a file for each
range, in the order of the ranges. Every row holds its document's ids with the end id behind them, the number of its range
(`part`) and the tokens of the range before it (`at`), so a token's place in the whole corpus is its range's offset plus a number
in the row, and offsets take one aggregate over two small columns. Columns of integers are run-length encoded; stripes are
bounded in bytes and can be read by different tasks; each stripe has an index entry with least and greatest values for every
`STRIDE` rows and a Bloom filter of document ids, which Spark's reader uses for filters on `doc_id`, `part` and `at`.

Encoding: the library's pre-tokenizer always ends a piece before a single space or line break between two other characters,
behind such a line break, and between a Latin letter and one of a few marks. Texts are cut there, and ids of up to `REMEMBERED`
pieces are kept by each Python worker. New pieces go to the library together, a line for each, as a line break has an id of its own.
Added tokens that a text spells out are recognised, as the library does by default.

Null texts are empty and have the end id only. Null ids are the last ones. Rows with one id are ordered by the hash of their
text; rows alike in both are spread over ranges by their place in the input. An empty table gives files without rows and an
empty result. Further columns of the documents are not written.
"""

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.llm.common import ship
from salesloom.sources.storage import scratch_path

STRIPE_BYTES, STRIDE, FALSE_POSITIVES = 16 << 20, 1_000, 0.01
REMEMBERED, LONGEST = 1_000_000, 64
END = 0
SCHEMA = "doc_id bigint, part int, at bigint, n_tokens bigint, ids array<int>"
LINES, GROUP = 200, 8 << 20
#: White space as the vocabulary's pattern and any other reading of it may have it, inside a class of a regular expression.
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = f"[{_WHITE}] | [{_WHITE}]|^ | $"
_MARK = "\x01"


def _cut(texts: pa.StringArray) -> pa.StringArray:
    """Texts with `_MARK` where the pre-tokenizer ends a piece whatever stands around."""
    odd = pc.match_substring_regex(texts, _ODD)
    cut = pc.replace_substring(texts, " ", f"{_MARK} ")
    if pc.any(odd).as_py():
        cut = pc.replace_with_mask(cut, odd, pc.replace_substring_regex(texts.filter(odd), f"([^{_WHITE}]) ([^{_WHITE}])", rf"\1{_MARK} \2"))
    cut = pc.replace_substring_regex(cut, r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?\n])", rf"\1{_MARK}\2")
    return pc.replace_substring_regex(cut, f"([^{_WHITE}])\n([^{_WHITE}])", f"\\1{_MARK}\n{_MARK}\\2")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.line = int(np.frombuffer(self._one("\n"), "<u4")[0])

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: those without line breaks and odd spaces all in one text, a line for each."""
        known, plain = self.known, []
        for piece in pieces:
            bare = piece[1:] if piece[:1] == " " else piece
            if bare and bare.strip() is bare and "\n" not in bare:
                plain.append(piece)
            else:
                known[piece] = self._one(piece)
        for start in range(0, len(plain), LINES):
            some = plain[start:start + LINES]
            raw = self._one("\n".join([*some, ""]))
            ends = np.nonzero(np.frombuffer(raw, "<u4") == self.line)[0].tolist()
            assert len(ends) == len(some)
            at = 0
            for piece, end in zip(some, ends):
                known[piece] = raw[at:4 * end]
                at = 4 * end + 4

    def encode_all(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after the other, and how many each text has, with `end` behind those of each."""
        lists = pc.split_pattern(_cut(texts), _MARK)
        pieces = lists.values.dictionary_encode()
        code, words = pieces.indices.to_numpy(zero_copy_only=False), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        edges = lists.offsets.to_numpy()
        table = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(table) if ids is None]
        self._learn([words[i] for i in new])
        for i in new:
            table[i] = self.known[words[i]]
        if len(self.known) > self.remembered:  # what these texts have is the most frequent part of it
            self.known = {x: ids for x, ids in zip(words, table) if len(x) <= LONGEST}
        for i in np.nonzero(pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False))[0]:  # holds the mark itself
            code = code.copy()
            code[edges[i]] = len(table)
            code[edges[i] + 1:edges[i + 1]] = -1
            table.append(self._one(texts[i].as_py()))
        table += [b"" if end is None else np.array([end], "<u4").tobytes(), b""]  # code -1 is nothing
        code = np.insert(code, edges[1:], len(table) - 2)
        edges = edges + np.arange(len(edges), dtype=np.int32)

        sizes = np.fromiter(map(len, table), np.int32, len(table)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[code]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(starts[code] - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        before = np.concatenate([np.zeros(1, np.int32), ends])[edges]
        return np.frombuffer(b"".join(table), "<u4")[at], np.diff(before).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(SparkFiles.get(name))
    return _ENCODERS[name]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `GROUP` bytes of text, which are encoded together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        for i, more in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if size and size + more > GROUP:
                yield from pa.Table.from_batches([*held, batch.slice(start, i - start)]).combine_chunks().to_batches()
                held, size, start = [], 0, i
            size += more
        held.append(batch.slice(start))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _order(key: str, text: str) -> list[Column]:
    return [F.col(key).isNull().alias("none"), F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place")]


def write_tokens(df: DataFrame, key: str, text: str, tokenizer: str, path: str, end: int = END) -> str:
    """Write the ids of all texts below `path`; `tokenizer` is a file on the driver, which sends it to the executors."""
    spark = df.sparkSession
    ship(spark)
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    rows = df.select(*_order(key, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["none", "doc_id", "hash", "place"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encode = _encoder(name).encode_all
        for batch in _groups(batches):
            ids, lengths = encode(batch.column(1), end)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int32)))
            columns = [batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at + edges[:-1]), pa.array(lengths), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids"])
            at += int(edges[-1])

    options = {"orc.stripe.size": str(STRIPE_BYTES), "orc.create.index": "true", "orc.row.index.stride": str(STRIDE),
               "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "maxRecordsPerFile": "0", "compression": "lz4"}  # run lengths leave little to compress
    ranged.mapInArrow(run, SCHEMA).write.options(**options).orc(path)
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, tokens, before): a row for each file, with the tokens of the files before it."""
    totals = _rows(spark, path).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return totals.select("part", "tokens", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; start counts the ids of all documents before."""
    files = offsets(spark, path).select("part", "before")
    return _rows(spark, path).join(F.broadcast(files), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")  # a row for each file


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of the given documents; Bloom filters and index entries keep other stripes and rows from being read."""
    return _rows(spark, path).where(F.col("doc_id").isin(*ids)).select("doc_id", "n_tokens", "ids")


def token_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents with ids from place `start` to before place `stop`; reads the files it needs."""
    found = offsets(spark, path).where((F.col("before") < stop) & (F.col("before") + F.col("tokens") > start)).agg(F.min("part"), F.max("part"), F.min("before")).first()
    if found[0] is None:
        return read_tokens(spark, path).where(F.lit(False))
    files = offsets(spark, path).select("part", "before")
    kept = _rows(spark, path).where((F.col("part") >= found[0]) & (F.col("part") <= found[1]) & (F.col("at") < stop - found[2]))
    placed = kept.join(F.broadcast(files), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")  # a row for each file
    return placed.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))


def checksums(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of `read_tokens`."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, edges = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            found = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_report(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files below the shared folder."""
    spark = df.sparkSession
    path = write_tokens(df, key, text, tokenizer, scratch_path(spark, "tokens"))
    return checksums(read_tokens(spark, path))
