from collections import Counter, defaultdict

import pytest

from llm.helpers import docs, rows_of, words
from salesloom.llm import lines


def by_rule(rows, ratio, least):
    pages, counts = Counter(h for _, _, h in rows), defaultdict(Counter)
    for _, text, host in rows:
        counts[host].update({x.strip(" \t\r") for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, host in rows:
        bad = {x for x, n in counts[host].items() if n >= least and n > ratio * pages[host]}
        out.append((i, None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in bad)))
    return sorted(out, key=repr)


ROWS = [(i, f"menu\n{words(5, i)}\n\n  foot \nmenu", "a") for i in range(12)] + [(100 + i, f"rare {i}\n{'menu' if i < 2 else words(3, 50 + i)}", "b") for i in range(20)]
ROWS += [(200 + i, "alone\nagain", None) for i in range(6)] + [(300, None, "a"), (301, "", "a"), (302, "foot", "a"), (302, "foot", "a"), (None, "menu\nx", "c"), (303, "foot\n" * 5000 + words(30_000, 1), "a")]


@pytest.mark.parametrize(("ratio", "least"), [(0.2, 5), (0.05, 2), (0.9, 1)])
def test_equals_the_rule(spark, ratio, least):
    table = docs(spark, ROWS)
    got = lines.drop_frequent_lines(table, "source", "text", ratio, least)
    assert got.columns == table.columns
    assert rows_of(got, "doc_id", "text") == by_rule(ROWS, ratio, least)


def test_counts_and_second_column(spark):
    got = lines.drop_frequent_lines(docs(spark, ROWS), "source", "text", 0.2, 5, kept="new", dropped="gone")
    by_id = {r.doc_id: (r.text, r.new, r.gone) for r in got.collect()}
    assert by_id[302] == ("foot", "", 1) and by_id[300] == (None, None, 0) and by_id[0][2] == 3 and by_id[100][2] == 0


def test_empty_table(spark):
    assert lines.drop_frequent_lines(docs(spark, []), "source", "text").collect() == []


def test_hosts_and_page_text(spark):
    rows = [("HTTP://user@Site.example:80/a?b#c", "<p>one <b>two</b><br>three&amp;lt;</p><script>x<p></script>"), ("nothing", None), (None, "<!-- <p>no</p> -->  a\n b <DIV class='x'>c</div>")]
    df = spark.createDataFrame(rows, "url string, html string").select(lines.host_of("url").alias("h"), lines.page_text("html").alias("t"))
    assert [tuple(r) for r in df.collect()] == [("site.example", "one two\nthree&lt;"), (None, None), (None, "a  b\nc")]
