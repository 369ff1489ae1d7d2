"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source gets its weight's share of the words to be mixed. A source whose share passes `max_epochs` times its size is
clamped there, and what is over goes to the others in proportion to their weights, until none is above its cap. Targets
come from whole numbers by one multiplication and two divisions, so every engine finds the same.

A target is met by whole repetitions of all documents of the source plus one more of some. Those are taken in an order
that hashes the seed and the document's id: the first ones until the next is too much, then, twice more, those behind that
are no larger than what is still missing, and at last the one that comes nearest to the rest, if that brings the sum nearer.
The place of a cut is found in two steps, by sums of `SLICES` ranges of the hash and then within one range, so that no
task ever orders a whole source. Documents meet the cuts of their source in a join on the source with one row per source;
texts are not moved by it unless sources are so many that the table of cuts is too large to send.

Null texts have size 0; null sources are one source, the last one. Documents of size 0 take no words and are repeated like
their source's whole epochs. Documents with the same id (or none) share a hash: they fall on the same side of the cut if
their sizes are equal, else in order of size. Repeated rows stay rows. An empty table gives an empty result, and nothing
can be mixed from sources without words: their target is 0.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.llm.common import fresh, written
from salesloom.operators.ordering import number_rows

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MAX_EPOCHS, SEED = 150, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SLICES, PASSES = 4096, 3


def size_of(text: str | Column) -> Column:
    """Number of words of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), a row per source.

    Weights repeat over the sources in order of their code points, null last. With 100 x max_epochs < percent no mix is
    large enough, and all sources are clamped.
    """
    order = [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")]
    placed = number_rows(sizes.select("source", "source_size"), order, "_place", 0)
    own = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    named = written(placed.select("source", "source_size", own.cast("bigint").alias("weight")), "sources")
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * percent  # in hundredths of a word
    cap, clamped = F.col("source_size") * (100 * max_epochs), F.lit(False)
    before = -1
    while True:
        free, count, given = named.select((~clamped).alias("free"), clamped.alias("c"), "weight", cap.alias("cap")).agg(
            F.coalesce(F.sum(F.when(F.col("free"), F.col("weight"))), F.lit(0)), F.count_if("c"), F.coalesce(F.sum(F.when(F.col("c"), F.col("cap"))), F.lit(0))).first()
        if count == before or not free:
            break
        before = count
        # Two numbers say which sources are clamped: those whose cap per weight is under what is left per free weight.
        clamped = cap.cast("decimal(38,0)") * F.lit(int(free)).cast("decimal(19,0)") < F.col("weight").cast("decimal(10,0)") * F.lit(int(total - given)).cast("decimal(27,0)")
    rest = F.col("weight") * F.lit(float(total - given)) / F.lit(float(max(1, free))) / F.lit(100.0)
    return named.withColumn("target", F.when(clamped | F.lit(not free), cap.cast("double") / F.lit(100.0)).otherwise(rest))


def _order_key(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _step(rows: DataFrame, state: DataFrame) -> DataFrame:
    """`state` after one more pass in the order of (hash, size): documents behind the cut that are no larger than what is
    missing are taken until the next one would be too much."""
    left = state.select("source", "missing", "cut_hash", "cut_size")
    behind = "(hash > cut_hash OR (hash = cut_hash AND size > cut_size))"
    open_ = rows.join(left, F.col("own").eqNullSafe(F.col("source"))).where(f"size > 0 AND size <= missing AND {behind}").select("own", "hash", "size", "slice", "missing")

    sums = open_.groupBy("own", "slice").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"))
    earlier = Window.partitionBy("own").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows at most
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    all_of = sums.groupBy(F.col("own").alias("all_own")).agg(F.sum("words").alias("all"))
    held = sums.where("missing < before + words AND before <= missing").select(F.col("own").alias("of"), F.col("slice").alias("held"), "before")

    inside = open_.join(held, F.col("own").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("held")))
    so_far = F.sum("size").over(Window.partitionBy("own", "slice").orderBy("hash", "size"))  # rows alike count together
    inside = inside.withColumn("got", F.col("before") + so_far).where("got <= missing")
    reached = inside.groupBy(F.col("own").alias("reached")).agg(F.max(F.struct("hash", "size", "got")).alias("at"))

    met = state.join(all_of, F.col("source").eqNullSafe(F.col("all_own")), "left").join(held, F.col("source").eqNullSafe(F.col("of")), "left")
    met = met.join(reached, F.col("source").eqNullSafe(F.col("reached")), "left")
    cut_hash = F.coalesce("at.hash", "held", F.lit("g"))  # a slice sorts before all that is in it, g behind every hash
    cut_size = F.coalesce("at.size", F.lit(-1).cast("bigint"))
    got = F.coalesce("at.got", "before", "all", F.lit(0))
    return met.select(
        "source", "source_size", "target", "whole", cut_hash.alias("cut_hash"), cut_size.alias("cut_size"), (F.col("missing") - got).alias("missing"),
        F.concat("steps", F.array(F.struct(F.col("missing").alias("most"), cut_hash.alias("hash"), cut_size.alias("size")))).alias("steps"))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, steps, last): one row per source.

    `rows` has source, hash and size of each document, `plan` the targets. Documents that are no larger than a step's `most`
    and up to its (hash, size) are taken once more than `whole`, and so is the one at `last` (hash, size), which is null
    where none brings the sum nearer.
    """
    assert SLICES == 16 ** 3
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = plan.select("source", "source_size", "target", whole.alias("whole"), F.lit("").alias("cut_hash"), F.lit(-1).cast("bigint").alias("cut_size"),
                        (F.col("target") - whole * F.col("source_size")).alias("missing"), F.array().cast("array<struct<most:double,hash:string,size:bigint>>").alias("steps"))
    rows = rows.select(F.col("source").alias("own"), "hash", "size", F.substring("hash", 1, 3).alias("slice"))
    for _ in range(PASSES):
        state = written(_step(rows, state), "cuts")
    after = rows.join(state.select("source", "cut_hash", "cut_size", "missing"), F.col("own").eqNullSafe(F.col("source")))
    after = after.where("size > 0 AND size < 2 * missing AND (hash > cut_hash OR (hash = cut_hash AND size > cut_size))")
    last = after.groupBy(F.col("own").alias("last_own")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "hash", "size")).alias("last"))
    return state.join(last, F.col("source").eqNullSafe(F.col("last_own")), "left").select("source", "source_size", "target", "whole", "steps", "last")


def copies() -> Column:
    """How often a row with hash, size and its source's cuts is taken."""
    size, hash_ = F.col("size"), F.col("hash")
    in_step = F.exists("steps", lambda s: (size > 0) & (size <= s["most"]) & ((hash_ < s["hash"]) | ((hash_ == s["hash"]) & (size <= s["size"]))))
    closing = F.expr("hash = last.hash AND size = last.size")
    return F.col("whole") + F.coalesce(in_step, F.lit(False)).cast("bigint") + F.coalesce(closing, F.lit(False)).cast("bigint")


def sized(df: DataFrame, key: str, text: str, source: str, seed: str = SEED) -> DataFrame:
    """(key, source, hash, size) of every row."""
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), _order_key(key, seed).alias("hash"), size_of(text).alias("size"))


def plan_mix(rows: DataFrame) -> DataFrame:
    """The cuts of the sources of `sized` rows, as a table."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return written(cuts(rows, targets(sizes)), "mix")


def mix_report(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """For every row: key, size, source_size, target and taken, the words that the mix takes of it."""
    rows = written(sized(df, key, text, source), "sizes")
    plan = plan_mix(rows).withColumnRenamed("source", "of")
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return met.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The rows of the mix: all columns of df, each row as often as it is taken."""
    plan = plan_mix(written(sized(df, key, text, source), "sizes")).withColumnRenamed("source", "of")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    met = df.select(row, F.col(source).alias("source"), _order_key(key, SEED).alias("hash"), size_of(text).alias("size"))
    met = met.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("row", F.explode(F.array_repeat(F.lit(0), copies().cast("int"))))
    return met.select("row.*")


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
o AS (  -- caps in order of the level at which they are met
  SELECT *, 200 * source_size AS cap, row_number() OVER (ORDER BY 200.0 * source_size / weight, source NULLS LAST) AS place FROM s),
c AS (
  SELECT *, sum(cap) OVER (ORDER BY place) - cap AS caps_before, sum(weight) OVER (ORDER BY place) - weight AS weights_before,
         sum(weight) OVER () AS weights, 150 * sum(source_size) OVER () AS total FROM o),
k AS (SELECT *, cap * (weights - weights_before) < weight * (total - caps_before) AS clamped FROM c),
f AS (
  SELECT any_value(total) - coalesce(sum(cap) FILTER (clamped), 0) AS rest, sum(weight) FILTER (NOT clamped) AS free FROM k),
t AS (
  SELECT source, source_size, CASE WHEN clamped OR free IS NULL THEN cap::DOUBLE / 100.0 ELSE weight * rest::DOUBLE / free::DOUBLE / 100.0 END AS target
  FROM k, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
"""
_PASS_SQL = """r{n} AS (
  SELECT *, size > 0 AND size <= missing AND (hash, size) > (cut_hash, cut_size) AS open_{n},
         sum(CASE WHEN size > 0 AND size <= missing AND (hash, size) > (cut_hash, cut_size) THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY hash, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS got_{n}
  FROM {before}),
g{n} AS (
  SELECT * EXCLUDE (taken, missing, cut_hash, cut_size), taken OR (open_{n} AND got_{n} <= missing) AS taken,
         missing - coalesce(max(got_{n}) FILTER (open_{n} AND got_{n} <= missing) OVER (PARTITION BY source), 0) AS missing,
         CASE WHEN bool_or(open_{n} AND got_{n} > missing) OVER (PARTITION BY source)
              THEN coalesce(max((hash, size)) FILTER (open_{n} AND got_{n} <= missing) OVER (PARTITION BY source), (cut_hash, cut_size))
              ELSE ('g', 0::BIGINT) END AS cut_{n}
  FROM r{n}),
h{n} AS (SELECT * EXCLUDE (cut_{n}), cut_{n}[1] AS cut_hash, cut_{n}[2] AS cut_size FROM g{n}),
"""
MIX_SQL += """r AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing, '' AS cut_hash, -1::BIGINT AS cut_size, false AS taken
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
""" + "".join(_PASS_SQL.format(n=n, before=f"h{n - 1}" if n else "r") for n in range(PASSES)) + f"""l AS (
  SELECT source, arg_min((hash, size), (abs(size - missing), hash, size)) AS last
  FROM h{PASSES - 1} WHERE (hash, size) > (cut_hash, cut_size) AND size > 0 AND size < 2 * missing GROUP BY source)
SELECT h.doc_id, h.size, h.source_size, h.target,
       (h.size * (h.whole + CASE WHEN h.taken THEN 1 ELSE 0 END + CASE WHEN (h.hash, h.size) = l.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM h{PASSES - 1} h LEFT JOIN l ON h.source IS NOT DISTINCT FROM l.source
"""
