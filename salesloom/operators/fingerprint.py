"""Content fingerprints of tables, and stored results that stay valid while their tables do.

A fingerprint is the XOR, the sum and the count of row hashes, so it follows changes without a scan of the table: rows that
leave are taken off, rows that enter are put on (`delta`, `advance`). A change by upsert, delete or merge knows both. `verify`
compares kept fingerprints with the tables themselves now and then.
"""

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.text import normalize_question
from salesloom.operators.limiter import micros_of
from salesloom.sources.tables import read_json, write_json

ENTRY_SCHEMA = "kind string, key string, payload string, deps string"


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row with NULLs in their places (`xxhash64` alone skips them)."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))


PARTS_SCHEMA = "table string, x bigint, s decimal(38,0), n bigint"


def fingerprint_parts(df: DataFrame, table: str) -> DataFrame:
    """One row `table, x, s, n`: XOR, sum and count of row hashes, combined on the map side, in any row order.

    The sum and the count notice repeated rows, which cancel out in an XOR.
    """
    hashed = df.select(row_hash(df).alias("h"))
    return hashed.agg(F.lit(table).alias("table"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).cast("bigint").alias("x"),
                      F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("s"), F.count(F.lit(1)).alias("n"))


def as_fingerprints(parts: DataFrame) -> DataFrame:
    """`table, fingerprint` of rows of parts."""
    return parts.select("table", F.concat_ws(":", F.hex("x"), F.col("s").cast("string"), F.col("n").cast("string")).alias("fingerprint"))


def table_fingerprint(df: DataFrame, table: str) -> DataFrame:
    """One row `table, fingerprint`."""
    return as_fingerprints(fingerprint_parts(df, table))


def delta(leaving: DataFrame, entering: DataFrame, table: str) -> DataFrame:
    """The parts that rows leaving and entering a table add to its own. A row that is replaced leaves as it was and enters as it is;
    all columns count, in the table's order."""
    out, into = fingerprint_parts(leaving, table), fingerprint_parts(entering.select(*leaving.columns), table)
    return into.unionByName(out.withColumn("s", (-F.col("s")).cast("decimal(38,0)")).withColumn("n", -F.col("n")))


def advance(kept: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Kept parts of several tables after changes to some of them; no table is read."""
    rows = reduce(DataFrame.unionByName, deltas, kept)
    return rows.groupBy("table").agg(F.expr("bit_xor(x)").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"))


def verify(kept: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table) of the tables whose kept parts are not those of a full pass."""
    full = reduce(DataFrame.unionByName, [fingerprint_parts(df, name) for name, df in tables.items()])
    return kept.filter(F.col("table").isin(*tables)).exceptAll(full.select(*kept.columns)).unionByName(full.select(*kept.columns).exceptAll(kept)).select("table").distinct()


def keyed_delta(table_rows: DataFrame, changes: DataFrame, key: str, table: str) -> DataFrame:
    """The delta of an upsert: rows of the keys in `changes` leave, the changes enter. Only these keys' rows are hashed."""
    return delta(table_rows.join(changes.select(key), key, "left_semi").select(*table_rows.columns), changes, table)


def portable_checksum(df: DataFrame, table: str) -> DataFrame:
    """One row `table, rows, checksum` that other engines can compute too: the sum over all rows of the first twelve hexadecimal
    digits of the MD5 of the row's text. Numbers count in hundredths, times in microseconds."""
    def text(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "timestamp_ntz":
            c = micros_of(c)
        elif kind == "double":
            c = F.round(c * 100).cast("bigint")
        return F.coalesce(c.cast("string"), F.lit("~"))

    row = F.concat_ws("|", *[text(*column) for column in df.dtypes])
    part = F.conv(F.left(F.md5(row.cast("binary")), F.lit(12)), 16, 10).cast("decimal(20,0)")
    return df.agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum"))


def snapshot(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Fingerprints of all tables, taken before a result is computed: a change meanwhile makes the result miss."""
    return reduce(DataFrame.unionByName, [table_fingerprint(df, name) for name, df in tables.items()])


def text_fingerprint(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16))


def result_key(kind: Column, question: Column, version: Column) -> Column:
    """Key of a stored result: kind, version of what produced it, and the normalized question."""
    return text_fingerprint(kind, version, normalize_question(question))


def store_results(results: DataFrame, taken: DataFrame) -> DataFrame:
    """Entries from `results(kind, key, payload, tables array<string>)`; `deps` maps each table read to its fingerprint."""
    reads = results.select("kind", "key", F.explode("tables").alias("table")).join(taken, "table")
    deps = reads.groupBy("kind", "key").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("table", "fingerprint"))))).alias("deps"))  # five tables at most
    return results.join(deps, ["kind", "key"], "left").select("kind", "key", "payload", F.coalesce("deps", F.lit("{}")).alias("deps"))


def valid_entries(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Entries of which every table read still has the recorded fingerprint; other tables do not matter."""
    read = entries.select("kind", "key", F.explode(F.from_json("deps", "map<string,string>")).alias("table", "fingerprint"))
    changed = read.join(current, ["table", "fingerprint"], "left_anti").select("kind", "key").distinct()
    return entries.join(changed, ["kind", "key"], "left_anti")


def export_entries(entries: DataFrame, current: DataFrame, path: str) -> None:
    write_json(valid_entries(entries, current).select("kind", "key", "payload", "deps"), path)


def load_entries(spark, path: str, current: DataFrame) -> DataFrame:
    """Exported entries that match the current tables."""
    return valid_entries(read_json(spark, path, ENTRY_SCHEMA), current)
