"""Lines that a site repeats over its pages: menus, notices, footers.

The lines of a page are grouped by host; a line's ratio is the number of pages of the host that contain it by the number
of all pages of the host. Lines above `max_ratio` that are on at least `min_pages` pages are dropped wherever they occur
on that host. Lines are compared without outer white space, by their 64-bit hash with the length; empty lines are kept.

A page counts a line once, so counting is one aggregate by host and line that is combined before the shuffle, and the
lines of a host that fall are few by nature: each is on more than `max_ratio` of the pages, so there are fewer of them
than lines on a mean page divided by `max_ratio`. They meet the pages as one list per host, which moves no text where
all lists together are small enough for Spark to send, and is a join that Spark can split where a host is hot.

Groups broader than a host, such as sources, gather the pages of many sites, so a line that a site repeats is on a small
share of the group. With `different` only pages that differ elsewhere count. A first count of all pages gives the candidates, a
second one looks at what a page has beside all candidates of its group: pages whose rest begins with the same least line hash are
one, and so are all those whose rest is under a fifth of their characters, as they are copies or near copies of each other. What
a text shares with its own copies is no boilerplate then, and a block of many lines is found like a single one.

Null hosts are one host. Null texts have no lines and stay null. A page that loses all lines stays, with an empty text.
Rows that repeat are pages of their own. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import fresh, written

MAX_RATIO, MIN_PAGES = 0.2, 5
#: Boilerplate of a source: what a site with a twentieth of the source's documents would lose as a host (a fifth of its own
#: pages, a hundredth of the source), on different documents enough for two hosts.
SOURCE_RATIO, SOURCE_PAGES = MAX_RATIO / 20, 2 * MIN_PAGES
REST = 5  # a rest of at least one part of so many sets a page apart from its near copies
#: Tags between which a page's lines lie, and what is no text at all.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
HIDDEN = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))  # in this order


def host_of(url: str | Column) -> Column:
    """Host of a URL in lower case, without user and port; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def page_text(html: str | Column) -> Column:
    """The text of a page, a line for each block."""
    text = F.col(html) if isinstance(html, str) else html
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, r"[\r\n\t]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _id(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def _different(pages: DataFrame, host: str, text: str, common: DataFrame) -> DataFrame:
    """(host, line, n): the pages with each candidate of their host that have a rest of their own."""
    candidates = common.select(F.col("host").alias("of"), F.col("lines").alias("bad"))
    met = pages.select(F.col(host).alias("host"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("text")).join(candidates, F.col("host").eqNullSafe(F.col("of")))
    line = F.transform("text", lambda x: F.struct(_id(_bare(x)).alias("id"), F.length(_bare(x)).alias("n")))
    met = met.select("host", "bad", F.filter(line, lambda x: x["n"] > 0).alias("own"))
    in_bad = met.select("host", F.filter("own", lambda x: F.array_contains("bad", x["id"])).alias("held"), F.filter("own", lambda x: ~F.array_contains("bad", x["id"])).alias("rest"))

    def size(lines: str) -> Column:
        return F.aggregate(lines, F.lit(0), lambda total, x: total + x["n"])
    apart = size("rest") * REST >= size("held") + size("rest")
    rows = in_bad.select("host", F.when(apart, F.array_min(F.transform("rest", lambda x: x["id"]))).alias("least"), F.explode(F.array_distinct(F.transform("held", lambda x: x["id"]))).alias("line"))
    each = rows.groupBy("host", "line", "least").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))


def frequent_lines(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, different: bool = False) -> DataFrame:
    """(host, pages, lines): hosts with lines above the ratio, their pages, and the ids of those lines."""
    lines = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: _id(_bare(x))))
    # The id of the empty line stands for the page itself: every page counts it once.
    own = F.array_union(F.array(_id(F.lit(""))), lines)
    counts = pages.select(F.col(host).alias("host"), F.explode(own).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("n") >= min_pages) | (F.col("line") == _id(F.lit(""))))
    counts = written(counts, "lines")
    total = counts.where(F.col("line") == _id(F.lit(""))).select(F.col("host").alias("of"), F.col("n").alias("pages"))

    def above(lines: DataFrame) -> DataFrame:
        met = lines.join(total, F.col("host").eqNullSafe(F.col("of"))).where((F.col("n") > F.col("pages") * F.lit(max_ratio)) & (F.col("n") >= min_pages))
        return met.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_set("line").alias("lines"))
    common = above(counts.where(F.col("line") != _id(F.lit(""))))
    return above(_different(pages, host, text, written(common, "candidates"))) if different else common


def drop_frequent_lines(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                        kept: str | None = None, dropped: str | None = None, different: bool = False) -> DataFrame:
    """All rows and columns with `text` without its host's frequent lines.

    With `dropped` the number of lines that went is a further column; with `kept` the new text is one, and `text` stays.
    """
    common = written(frequent_lines(pages, host, text, max_ratio, min_pages, different), "frequent").select(F.col("host").alias(of := fresh(pages, "_of")), F.col("lines").alias(bad := fresh(pages, "_bad")))
    met = pages.join(common, F.col(f"`{host}`").eqNullSafe(F.col(of)), "left")
    split = F.split(F.col(f"`{text}`"), "\n")
    good = F.filter(split, lambda x: ~F.array_contains(F.col(bad), _id(_bare(x))))
    new = F.when(F.col(bad).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(good, "\n"))
    columns = [new.alias(c) if c == text and kept is None else F.col(f"`{c}`") for c in pages.columns]
    if kept:
        columns.append(new.alias(kept))
    if dropped:
        columns.append(F.when(F.col(bad).isNull() | F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(split) - F.size(good)).alias(dropped))
    return met.select(*columns)


def _pages_sql() -> str:
    text = "html"
    for pattern in HIDDEN:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    text = f"regexp_replace({text}, '[\\r\\n\\t]+', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)</?(?:{BLOCKS})\\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    text = f"regexp_replace(regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    return f"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host, {text} AS text
  FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT row_number() OVER () AS row_id, * FROM p),
x AS (SELECT row_id, host, trim(unnest(string_split(coalesce(text, ''), chr(10))), chr(32) || chr(9) || chr(13)) AS line FROM l),
f AS (
  SELECT x.host, line FROM (SELECT DISTINCT row_id, host, line FROM x WHERE line <> '') x JOIN h ON x.host IS NOT DISTINCT FROM h.host
  GROUP BY x.host, line, pages HAVING count(*) > pages * {MAX_RATIO}::DOUBLE AND count(*) >= {MIN_PAGES}),
b AS (SELECT host, list(line) AS bad FROM f GROUP BY host)
SELECT page_id, l.host, array_to_string(list_filter(string_split(text, chr(10)), lambda y: NOT list_contains(coalesce(bad, []), trim(y, chr(32) || chr(9) || chr(13)))), chr(10)) AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda y: list_contains(coalesce(bad, []), trim(y, chr(32) || chr(9) || chr(13))))) END::INTEGER AS dropped_lines
FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host
"""


PAGES_SQL = _pages_sql()
