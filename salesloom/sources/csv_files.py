"""CSV exports as string frames: encoding, size guards, header mapping and row numbers."""

import csv
import re
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.config import HEADER_SPELLINGS
from salesloom.sources.storage import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW = "_row"
BOM = "\ufeff"
# Messages of a refused import.
NO_DATA = "the CSV has no data rows or fewer than two columns"
NO_COMPANY = "map a column to Company"
NO_PERSON = "map a column to Email or to a name field"

#: A line that leaves quotes open: whole cells, quoted or not, and then one that opens quotes and doesn't close them.
_OPEN = re.compile(r'(?>(?>"(?>[^"]|"")*+"[^,]*+|(?!")[^,]*+),)*+"(?>[^"]|"")*+\Z')


class ImportRejected(ValueError):
    """The file itself cannot be imported: no CSV, too large, or a required mapping is missing."""


@dataclass(frozen=True)
class CsvScan:
    rows: DataFrame  # all headers as strings ('' for empty) plus `_row`, the line a spreadsheet shows
    headers: list[str]


def _as_utf8(cell: Column) -> Column:
    """A cell that was read as Latin-1, its bytes taken for UTF-8."""
    return F.encode(cell, "ISO-8859-1").cast("string")


def ends_open(line: str, inside: bool) -> bool:
    """Whether a cell's quotes are open at the end of a line that begins outside or inside of them."""
    return _OPEN.match('"' + line if inside else line) is not None


def _parts(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    """Lines as Latin-1, without their end, and how they end: a lone carriage return ends a line too."""
    for raw in lines:
        line = raw.decode("iso-8859-1")
        if "\r" not in line:
            yield line, "\n"
            continue
        *own, last = line.split("\r")
        for one in own[:-1]:
            yield one, "\r"
        if last == "" and own:
            yield own[-1], "\r\n"
        else:
            if own:
                yield own[-1], "\r"
            yield last, "\n"


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that come from one split of one file; a task reads its splits one after the other."""
    files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    at = 0
    while at < len(files):
        end = at + 1
        while end < len(files) and (files[end], starts[end]) == (files[at], starts[at]):
            end += 1
        yield (files[at], starts[at]), batch.slice(at, end - at)
        at = end


def _unmarked(lines: list[bytes], start: int, is_first: bool) -> list[bytes]:
    """Lines without the byte order mark at the start of a file."""
    return [lines[0].removeprefix(BOM.encode()), *lines[1:]] if is_first and not start else lines


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: whether it ends inside quotes if it begins outside, and if inside; whether in the latter case a record
    ends in it; whether its bytes are UTF-8; the file's size."""
    states: dict[tuple[str, int], list] = {}
    for batch in batches:
        for split, own in _by_split(batch):
            lines = _unmarked(own.column(0).to_pylist(), split[1], split not in states)
            state = states.setdefault(split, [False, True, False, True, own.column(3)[0].as_py()])
            for line, _ in _parts([x for x in lines if b'"' in x]):
                if '"' in line:
                    state[0], state[1] = ends_open(line, state[0]), ends_open(line, state[1])
                    state[2] = state[2] or not state[1]
            if state[3]:
                try:
                    for line in lines:
                        if not line.isascii():
                            line.decode()
                except UnicodeDecodeError:
                    state[3] = False
    columns = [[k[0] for k in states], [k[1] for k in states], *zip(*states.values())] if states else [[]] * 7
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4, pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "from_out", "from_in", "closes", "utf8", "size"])


def _cells(records: list[str]) -> pa.ListArray:
    csv.field_size_limit(sys.maxsize)
    return pa.array(list(csv.reader(records)), pa.list_(pa.string()))  # line breaks are inside quotes only


_RECORD = "file string, start bigint, place bigint, piece bigint, cells array<string>, text string"


def _cut_records(owners: dict[tuple[str, int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of the splits. What is open at the end of a split, and what closes it in later ones, are pieces of one record of
    the split where it began; `owners` says for each split that begins inside quotes which one that is."""
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, place, first, held = None, False, 0, False, []

        def rows(whole: list[str], pieces: list[str], at: int) -> pa.RecordBatch:
            """Whole records from place `at`, or one piece of a record, which stands at place `at` of its owner (unknown: null)."""
            n = len(whole) + len(pieces)
            file, start = split
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.string()), pa.array([owners[split] if pieces and first else start] * n, pa.int64()),
                pa.array([None] if pieces and first else range(at, at + n), pa.int64()), pa.array([start if pieces else None] * n, pa.int64()),
                _cells(whole) if whole else pa.array([None] * n, pa.list_(pa.string())), pa.array(pieces if pieces else [None] * n, pa.string())], names)

        for batch in batches:
            for own_split, own in _by_split(batch):
                fresh = own_split != split
                if fresh:
                    if held:
                        yield rows([], ["".join(held)], place)
                    split, inside, place, held = own_split, own_split in owners, 0, []
                    first = inside  # what comes first belongs to a record of an earlier split
                whole: list[str] = []
                for line, end in _parts(_unmarked(own.column(0).to_pylist(), own_split[1], fresh)):
                    before = inside
                    inside = ends_open(line, inside) if '"' in line else inside
                    if before or inside:
                        held += [line, end]
                        if inside:
                            continue
                        if first:  # closes here; its own line ends with it
                            yield rows([], ["".join(held[:-1])], place)
                            first = False
                        else:
                            whole.append("".join(held[:-1]))
                        held = []
                    elif line.strip(" \t"):
                        whole.append(line)
                if whole:
                    yield rows(whole, [], place)
                    place += len(whole)
        if held:
            yield rows([], ["".join(held)], place)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], _cells(batch.column(3).to_pylist())], ["file", "start", "place", "cells"])


def _split_owners(states: list) -> dict[tuple[str, int], int]:
    """For each split that begins inside quotes the start of the split where they were opened: states of splits are composed in order."""
    owners: dict[tuple[str, int], int] = {}
    file, inside, opened = None, False, 0
    for r in [*sorted(states, key=lambda r: (r["file"], r["start"])), None]:
        if r is None or r["file"] != file:
            if inside:
                raise ImportRejected(f"quotes of a cell are not closed: {file}")
            if r is None:
                break
            file, inside = r["file"], False
        if inside:
            owners[r["file"], r["start"]] = opened
        if not inside or r["closes"]:
            opened = r["start"]
        inside = r["from_in"] if inside else r["from_out"]
    return owners


def records_of(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(file, start, place, cells) of all records, headers too, byte by byte as Latin-1, and (file, utf8, size) of all files.

    Files are read twice, in splits. The first pass gives for each split whether it ends inside quotes, for a begin outside and
    for one inside; composed in the order of the splits, these say how each split begins. The second pass cuts records where
    quotes are closed. A record that goes over a split's end is put together from its pieces.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))
    states = lines.mapInArrow(_split_states, "file string, start bigint, from_out boolean, from_in boolean, closes boolean, utf8 boolean, size bigint").collect()  # a row for each split
    found = written(lines.mapInArrow(_cut_records(_split_owners(states)), _RECORD), "csv-records")
    pieces = found.where("text IS NOT NULL").groupBy("file", "start").agg(
        F.max("place").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))  # one record
    records = found.where("text IS NULL").select("file", "start", "place", "cells").unionAll(pieces.mapInArrow(_joined, "file string, start bigint, place bigint, cells array<string>"))
    files = spark.createDataFrame([(r["file"], r["utf8"], r["size"]) for r in states], "file string, utf8 boolean, size bigint")
    return records, files.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.max("size").alias("size"))


def scan_csv(spark: SparkSession, path: str | Sequence[str], max_bytes: int | None = None, max_rows: int | None = None) -> CsvScan:
    """Every column as text; files may have different columns, in any order, and line breaks in quoted cells.

    A file whose bytes are all valid UTF-8 is UTF-8, any other one Latin-1. Cells are found by the header of their own
    file, and a header that a file lacks is empty there. Lines of white space are no rows. `max_bytes` and `max_rows` refuse
    larger files; a file that ends inside quotes is refused.
    """
    records, kinds = records_of(spark, path)
    sizes = records.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = sizes.select("file", "start", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = written(offsets, "csv-splits")
    first = records.join(offsets.where("before = 0"), ["file", "start"], "left_semi").where("place = 0").select("file", F.col("cells").alias("names"))
    files = kinds.join(offsets.groupBy("file").agg((F.sum("n") - 1).alias("data_rows")), "file").join(first, "file")
    files = files.withColumn("names", F.when(F.col("utf8"), F.transform("names", _as_utf8)).otherwise(F.col("names")))
    files = written(files.withColumnRenamed("file", "of"), "csv-files")  # a row for each file
    size, rows, most = files.agg(F.max("size"), F.sum("data_rows"), F.max("data_rows")).first()
    if max_bytes is not None and (size or 0) > max_bytes:
        raise ImportRejected(f"a file is larger than {max_bytes // 1_000_000} MB")
    if max_rows is not None and (most or 0) > max_rows:
        raise ImportRejected(f"at most {max_rows} rows per file")
    kinds = files.groupBy("names").agg(F.min("of").alias("first")).orderBy("first").collect()  # a row for each different header line
    headers = list(dict.fromkeys(h for kind in kinds for h in kind["names"] if h))
    if not rows or len(headers) < 2:
        raise ImportRejected(NO_DATA)
    numbered = records.join(offsets.select("file", "start", "before"), ["file", "start"]).withColumn(ROW, F.col("before") + F.col("place") + 1)
    data = numbered.where(F.col(ROW) > 1).join(files.select("of", "utf8", "names"), F.col("file") == F.col("of"))

    def cell(header: str) -> Column:
        at = F.array_position("names", F.lit(header)).cast("int")
        value = F.coalesce(F.get("cells", F.greatest(at, F.lit(1)) - 1), F.lit(""))
        return F.when(at == 0, "").when(F.col("utf8"), _as_utf8(value)).otherwise(value).alias(header)

    return CsvScan(data.select(*[cell(h) for h in headers], F.col("file").alias("_file"), ROW), headers)


def propose_mapping(headers: Sequence[str]) -> dict[str, str | None]:
    """Target field to header: of all known spellings that occur, the better ones claim first; a header serves one target."""
    by_spelling = {re.sub("[^a-z0-9]+", "", h.lower()): h for h in headers}
    claims = [(target, by_spelling[s]) for target, spellings in HEADER_SPELLINGS.items() for s in spellings if s in by_spelling]
    mapping: dict[str, str | None] = {}
    claimed: set[str] = set()
    for target, header in claims:
        if target not in mapping and header not in claimed:
            mapping[target] = header
            claimed.add(header)
    return {target: mapping.get(target) for target in HEADER_SPELLINGS}


#: What a mapping must meet: each rule gives what is wrong with (mapping, headers), or nothing.
MAPPING_RULES: tuple[Callable[[Mapping[str, str | None], Sequence[str]], str], ...] = (
    lambda m, h: ", ".join(sorted(m.keys() - HEADER_SPELLINGS.keys())) and f"unknown fields: {', '.join(sorted(m.keys() - HEADER_SPELLINGS.keys()))}",
    lambda m, h: ", ".join(sorted({*filter(None, m.values())} - {*h})) and f"columns not in the file: {', '.join(sorted({*filter(None, m.values())} - {*h}))}",
    lambda m, h: "" if m.get("company") else NO_COMPANY,
    lambda m, h: "" if m.get("email") or m.get("first_name") or m.get("last_name") else NO_PERSON,
)


def check_mapping(mapping: Mapping[str, str | None], headers: Sequence[str]) -> dict[str, str | None]:
    """The mapping with every target, or `ImportRejected` with all that is wrong, before any job starts."""
    wrong = [text for rule in MAPPING_RULES if (text := rule(mapping, headers))]
    if wrong:
        raise ImportRejected("; ".join(wrong))
    return {target: None for target in HEADER_SPELLINGS} | dict(mapping)


def unmapped_headers(headers: Sequence[str], mapping: Mapping[str, str | None]) -> list[str]:
    return [h for h in headers if h not in set(mapping.values())]


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
