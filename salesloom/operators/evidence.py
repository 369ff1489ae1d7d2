"""Evidence audit: every ID and number a text states must occur in the result rows behind it.

Result rows come as `evidence(answer_id, row_no, cells)`, a cell being a struct of name and one of text,
whole number or real number. Checks are joins on (answer, ID) and (answer, number bucket), so an answer
with very many rows is spread over tasks; only what a text itself states is gathered per answer.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

from salesloom.config import (
    BRACKET_PATTERN, CELL_NUMBER_PATTERN, DATE_PATTERN, ID_PATTERN, NUMBER_PATTERN, SUMMARY_COLUMNS, SUMMARY_LABELED, SUMMARY_ROWS,
)
from salesloom.functions.clock import minute_text

CELL_TYPE = "struct<name:string,text:string,whole:bigint,real:double>"
# Finer stated numbers are compared in buckets of a millionth; the exact tolerance decides afterwards.
MAX_BUCKET_DECIMALS = 6


def ids_in(text: Column) -> Column:
    """Distinct row IDs in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(0)))


def is_id(text: Column) -> Column:
    return text.rlike(f"^(?:{ID_PATTERN})$")


def real_text(x: Column) -> Column:
    """A float as written in answers: two decimals at most, at least one."""
    rounded = F.bround(x, 2)
    short = F.when(rounded == F.floor(rounded), F.format_string("%.1f", rounded)).otherwise(
        F.regexp_replace(F.format_string("%.2f", rounded), "0$", ""))
    return F.when(x.isNotNull(), short)


def cell_text(cell: Column) -> Column:
    return F.coalesce(cell["text"], cell["whole"].cast("string"), real_text(cell["real"]))


def _id_cells(name: str, ids: Column) -> Column:
    return F.transform(F.filter(ids, is_id), lambda v: F.struct(
        F.lit(name).alias("name"), v.alias("text"), F.lit(None).cast("bigint").alias("whole"), F.lit(None).cast("double").alias("real")))


def to_cells(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a row as cells; timestamps to the minute, list columns as one cell per text."""
    cells = []
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        col, kind = F.col(field.name), field.dataType
        text = whole = real = F.lit(None)
        if isinstance(kind, StringType):
            text = col
        elif isinstance(kind, BooleanType):
            text = F.lit(None)
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            text = minute_text(col)
        elif isinstance(kind, DateType):
            text = col.cast("string")
        elif isinstance(kind, IntegralType):
            whole = col
        elif isinstance(kind, (DoubleType, FloatType)):
            real = col
        elif isinstance(kind, ArrayType):
            cells.append(_id_cells(field.name, col))
            continue
        cells.append(F.array(F.struct(F.lit(field.name).alias("name"), text.cast("string").alias("text"),
                                      whole.cast("bigint").alias("whole"), real.cast("double").alias("real"))))
    return F.concat(*cells)


# ------------------------------------------------------------------ the audit

def _all_cells(evidence: DataFrame) -> DataFrame:
    return evidence.select("answer_id", F.explode("cells").alias("c")).select("answer_id", "c.*")


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """Distinct (answer, ID) over all text cells."""
    found = F.explode(F.regexp_extract_all("text", F.lit(ID_PATTERN), F.lit(0))).alias("id")
    return _all_cells(evidence).filter(F.col("text").isNotNull()).select("answer_id", found).distinct()


def _plain_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def evidence_numbers(evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct (answer, number) a text may state: cells, numbers inside texts, the row count, the question's numbers."""
    cells = _all_cells(evidence)
    typed = cells.select("answer_id", F.coalesce("real", F.col("whole").cast("double")).alias("number")).filter(F.col("number").isNotNull())
    written = F.explode(F.regexp_extract_all("text", F.lit(CELL_NUMBER_PATTERN), F.lit(0))).alias("t")
    inside = cells.filter(F.col("text").isNotNull() & ~is_id(F.col("text"))).select("answer_id", written).select(
        "answer_id", _plain_number(F.col("t")).alias("number"))
    counted = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    rows = answers.select("answer_id").join(counted, "answer_id", "left").select(
        "answer_id", F.coalesce("n", F.lit(0)).cast("double").alias("number"))
    asked = F.explode(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("t")
    question = answers.select("answer_id", asked).select("answer_id", F.col("t").cast("double").alias("number"))
    return typed.unionByName(inside).unionByName(rows).unionByName(question).distinct()


def stated_numbers(answers: DataFrame) -> DataFrame:
    """Numbers a text states outside IDs and dates: answer_id, place, token, value, decimals, percent, tolerance."""
    masked = F.regexp_replace(F.regexp_replace("text", ID_PATTERN, " "), DATE_PATTERN, " ")
    tokens = answers.select("answer_id", F.posexplode(F.regexp_extract_all(masked, F.lit(NUMBER_PATTERN), F.lit(0))).alias("place", "token"))
    bare = F.replace(F.regexp_replace("token", "%+$", ""), F.lit(","), F.lit(""))
    decimals = F.length(F.regexp_extract(bare, r"\.(\d+)$", 1))
    return tokens.select("answer_id", "place", "token", bare.cast("double").alias("value"), decimals.alias("decimals"),
                         F.col("token").endswith("%").alias("percent"),
                         (F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + F.lit(1e-9)).alias("tolerance"))


def unsupported_numbers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stated numbers no evidence number rounds to. A percentage may also be a hundred times a number."""
    stated = stated_numbers(answers).withColumn("grain", F.least("decimals", F.lit(MAX_BUCKET_DECIMALS)))
    scale = F.pow(F.lit(10.0), F.col("grain"))
    near = F.array(*[F.rint(F.col("value") * scale) + F.lit(float(d)) for d in (-1, 0, 1)])
    asked = stated.withColumn("bucket", F.explode(near))
    numbers = evidence_numbers(evidence, answers)
    grains = stated.select("answer_id", "grain").distinct()
    readings = F.explode(F.array(F.struct(F.lit(False).alias("only_percent"), F.col("number").alias("allowed")),
                                 F.struct(F.lit(True).alias("only_percent"), (F.col("number") * 100).alias("allowed")))).alias("r")
    offered = (numbers.join(grains, "answer_id").select("answer_id", "grain", readings).select("answer_id", "grain", "r.*")
               .withColumn("bucket", F.rint(F.col("allowed") * scale)).distinct())
    matched = asked.join(offered, ["answer_id", "grain", "bucket"]).filter(
        (F.col("percent") | ~F.col("only_percent")) & (F.abs(F.col("value") - F.col("allowed")) <= F.col("tolerance")))
    return stated.join(matched.select("answer_id", "place").distinct(), ["answer_id", "place"], "left_anti").select(
        "answer_id", "place", "token")


def audit_texts(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict per `answers(answer_id, text, question)`: valid, cited, unknown_ids, unsupported_numbers, reason."""
    listed = rf"^\s*{ID_PATTERN}(?:\s*[,;]\s*{ID_PATTERN})*\s*$"
    brackets = F.filter(F.regexp_extract_all("text", F.lit(BRACKET_PATTERN), F.lit(1)), lambda b: ~b.rlike(listed))
    base = answers.select("answer_id", ids_in(F.col("text")).alias("cited"),
                          F.transform(brackets, lambda b: F.concat(F.lit("["), b, F.lit("]"))).alias("_brackets"))
    known = evidence_ids(evidence)
    has_ids = known.select("answer_id").distinct().withColumn("_has_ids", F.lit(True))

    def gathered(df: DataFrame, value: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("place", value)))  # bounded by what one text states
        return df.groupBy("answer_id").agg(ordered.alias("_list")).select("answer_id", F.col(f"_list.{value}").alias(name))

    cited = base.select("answer_id", F.posexplode("cited").alias("place", "id"))
    unknown = gathered(cited.join(known, ["answer_id", "id"], "left_anti"), "id", "_unknown")
    numbers = gathered(unsupported_numbers(answers, evidence), "token", "_numbers")
    none = F.array().cast("array<string>")
    joined = (base.join(unknown, "answer_id", "left").join(numbers, "answer_id", "left").join(has_ids, "answer_id", "left")
              .withColumn("unknown_ids", F.concat(F.coalesce("_unknown", none), F.col("_brackets")))
              .withColumn("unsupported_numbers", F.coalesce("_numbers", none)))
    reason = (
        F.when(F.size("unknown_ids") > 0, F.concat(F.lit("cites references that are not row IDs in the query result: "),
                                                   F.array_join("unknown_ids", ", ")))
        .when(F.size("unsupported_numbers") > 0, F.concat(F.lit("states numbers not in the query result: "),
                                                          F.array_join("unsupported_numbers", ", ")))
        .when(F.coalesce("_has_ids", F.lit(False)) & (F.size("cited") == 0), "makes claims without citing any row ID")
    )
    return joined.select("answer_id", reason.isNull().alias("valid"), "cited", "unknown_ids", "unsupported_numbers", reason.alias("reason"))


# ------------------------------------------------------------------ deterministic summaries

def summarize_rows(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One sentence per answer built only from its rows: `answer_id, summary`."""
    from salesloom.operators.ordering import top_k_per_group

    sizes = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    with_ids = evidence_ids(evidence).select("answer_id").distinct().withColumn("_has_ids", F.lit(True))
    first = top_k_per_group(evidence, ["answer_id"], [F.asc("row_no")], SUMMARY_ROWS)
    filled = F.filter("cells", lambda c: cell_text(c).isNotNull())
    ident = F.get(F.filter("cells", lambda c: c["text"].isNotNull() & is_id(c["text"])), F.lit(0))["text"]

    def named(column: str) -> Column:
        return F.get(F.filter(filled, lambda c: c["name"] == column), F.lit(0))

    preferred = F.slice(F.filter(F.array(*[named(c) for c in SUMMARY_COLUMNS]), lambda c: c.isNotNull()), 1, 3)
    others = F.slice(F.filter(filled, lambda c: c["text"].isNull() | ~is_id(c["text"])), 1, 3)

    def worded(c: Column) -> Column:
        bare = c["name"].isin(*[n for n in SUMMARY_COLUMNS if n not in SUMMARY_LABELED])
        return F.when(bare, cell_text(c)).otherwise(F.concat(F.replace(c["name"], F.lit("_"), F.lit(" ")), F.lit(" "), cell_text(c)))

    body = F.array_join(F.transform(F.when(F.size(preferred) > 0, preferred).otherwise(others), worded), ", ")
    line = F.when(ident.isNotNull(), F.concat(F.lit("["), ident, F.lit("] "), body)).otherwise(body)
    plain = F.array_join(F.transform("cells", lambda c: F.concat(F.replace(c["name"], F.lit("_"), F.lit(" ")), F.lit(": "),
                                                                 F.coalesce(cell_text(c), F.lit("None")))), "; ")
    lines = first.select("answer_id", "position", line.alias("line"), plain.alias("plain")).groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_lines"), F.min_by("plain", "position").alias("_plain"))
    n = F.coalesce("n", F.lit(0))
    more = F.when(n > SUMMARY_ROWS, F.concat(F.lit(f" (showing {SUMMARY_ROWS} of "), n.cast("string"), F.lit(")"))).otherwise("")
    text = (
        F.when(n == 0, "No matching records were found.")
        .when((n == 1) & F.col("_has_ids").isNull(), F.concat(F.col("_plain"), F.lit(".")))
        .otherwise(F.concat(n.cast("string"), F.lit(" matching rows"), more, F.lit(": "), F.array_join("_lines.line", "; "), F.lit(".")))
    )
    return (answers.select("answer_id").join(sizes, "answer_id", "left").join(with_ids, "answer_id", "left")
            .join(lines, "answer_id", "left").select("answer_id", text.alias("summary")))
