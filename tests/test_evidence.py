"""Texts are put together from fragments whose effect on the verdict is known; the expectation follows from the parts."""

import random

import pytest
from pyspark.sql import functions as F

from salesloom.operators import evidence as ev


class Text:
    """A text about some rows, and what the audit has to find in it."""

    def __init__(self, rng, with_ids=True):
        self.rng, self.parts, self.cited, self.lost, self.brackets, self.wrong = rng, [], [], [], [], []
        self.ids = [f"{rng.choice(['LD', 'CO', 'ACT', 'ISS'])}-{rng.randrange(10**5):05d}" for _ in range(3)] if with_ids else []
        self.amounts = [round(rng.uniform(20_000, 90_000), 3) for _ in range(3)]
        self.share, self.seen = round(rng.uniform(0.1, 0.9), 3), rng.randrange(2000, 9000)
        self.rows = [{**({"record": i} if i else {}), "owner": rng.choice(["Uma", "Veit"]), "amount": a, "visits": self.seen + n, "share": self.share,
                      "noted": "on 2026-05-09 11:30"} for n, (i, a) in enumerate(zip(self.ids or [None] * 3, self.amounts))]
        self.question = f"the best {rng.randrange(300, 400)} of all?" if rng.random() < 0.5 else None

    def cite(self):
        one = self.rng.choice(self.ids)
        self.parts.append(self.rng.choice([f"[{one}]", f"see {one}", f"({one})"]))
        self.cited.append(one)

    def cite_several(self):
        some = self.rng.sample(self.ids, 2)
        self.parts.append(f"[{some[0]}{self.rng.choice([', ', '; ', ','])}{some[1]}]")
        self.cited += some

    def cite_stranger(self):
        one = f"LD-{self.rng.randrange(10**6, 10**7)}"
        self.parts.append(f"[{one}]")
        self.cited.append(one)
        self.lost.append(one)

    def odd_bracket(self):
        inside = self.rng.choice(["table above", "note a", "as told"])
        self.parts.append(f"[{inside}]")
        self.brackets.append(f"[{inside}]")

    def amount(self):
        digits = self.rng.randrange(4)
        self.parts.append(f"{self.rng.choice(self.amounts):,.{digits}f}" if digits else f"{round(self.rng.choice(self.amounts))}")

    def amount_off_by_one_digit(self):
        digits = self.rng.randrange(4)
        token = f"{self.rng.choice(self.amounts) + 3 * 10.0 ** -digits:.{digits}f}"
        self.parts.append(token)
        self.wrong.append(token)

    def percent(self):
        self.parts.append(f"{100 * self.share:.1f}%")

    def wrong_percent(self):
        token = f"{100 * self.share + 700:.0f}%"
        self.parts.append(token)
        self.wrong.append(token)

    def date(self):
        self.parts.append("since 2031-12-24")  # dates are no numbers

    def rows_found(self):
        self.parts.append(f"{len(self.rows)} rows")

    def asked_for(self):
        if self.question:
            self.parts.append(self.question.split()[2])

    def sum_of_all(self):
        token = f"{sum(self.amounts):.2f}"  # a computed number is in no cell
        self.parts.append(token)
        self.wrong.append(token)

    def text(self):
        return " and ".join(["Uma leads", *self.parts]) + "."

    def verdict(self):
        cited = list(dict.fromkeys(self.cited))
        unknown = [*dict.fromkeys(self.lost), *self.brackets]
        return not unknown and not self.wrong and bool(cited or not self.ids), cited, unknown, self.wrong


FINE = ["cite", "cite_several", "amount", "percent", "date", "rows_found", "asked_for"]
FAULTS = ["cite_stranger", "odd_bracket", "amount_off_by_one_digit", "wrong_percent", "sum_of_all"]


def built(seed):
    rng = random.Random(seed)
    texts = []
    for n in range(60):
        t = Text(rng, with_ids=n % 5 != 0)
        for _ in range(rng.randrange(1, 6)):
            part = rng.choice(FINE)
            if t.ids or not part.startswith("cite"):
                getattr(t, part)()
        for _ in range(rng.choice([0, 0, 1, 2])):
            getattr(t, rng.choice(FAULTS))()
        texts.append(t)
    return texts


def cells(row):
    return [(name, v if isinstance(v, str) else None, v if isinstance(v, int) else None, v if isinstance(v, float) else None) for name, v in row.items()]


def frames(spark, items):
    answers = spark.createDataFrame([(f"a{i:03d}", text, question) for i, (text, _, question) in enumerate(items)], "answer_id string, text string, question string")
    rows = [(f"a{i:03d}", n, cells(r)) for i, (_, rs, _) in enumerate(items) for n, r in enumerate(rs)]
    return answers, spark.createDataFrame(rows, f"answer_id string, row_no bigint, cells array<{ev.CELL_TYPE}>").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_follow_from_the_parts(spark, seed):
    texts = built(seed)
    got = {r.answer_id: r for r in ev.audit_texts(*frames(spark, [(t.text(), t.rows, t.question) for t in texts])).collect()}
    assert {t.verdict()[0] for t in texts} == {True, False}
    for i, t in enumerate(texts):
        r = got[f"a{i:03d}"]
        assert (r.valid, r.cited, r.unknown_ids, r.unsupported_numbers) == t.verdict(), t.text()
        names = [w for w, found in (("not row IDs", t.verdict()[2]), ("numbers not in", t.wrong and not t.verdict()[2])) if found]
        assert (r.reason is None) == r.valid and all(n in r.reason for n in names)


def test_rounding_at_every_precision(spark):
    """A stated number holds if a cell rounds to it at the stated number of decimals, and not one step beside."""
    x, items, want = 58.4037261549, [], []
    for digits in range(8):
        for step in (0, 1, -1):
            items.append((f"It is {x + step * 10.0 ** -digits:.{digits}f}", [{"x": x}], None))
            want.append(step == 0)
    got = {r.answer_id: r.valid for r in ev.audit_texts(*frames(spark, items)).collect()}
    assert [got[f"a{i:03d}"] for i in range(len(items))] == want


def test_texts_without_rows(spark):
    got = ev.audit_texts(*frames(spark, [("Not one.", [], None), ("Not one of 40.", [], None), ("Not one of 40.", [], "of 40?"), ("0 of them", [], None), ("", [], None)])).orderBy("answer_id").collect()
    assert [(r.valid, r.unsupported_numbers) for r in got] == [(True, []), (False, ["40"]), (True, []), (True, []), (True, [])]


def summaries():
    rng = random.Random(8)
    amounts = [round(rng.uniform(10, 99), 2) + 0.001 for _ in range(7)]
    many = [{"firm_size": n, "paid": x} for n, x in enumerate(amounts)]
    shown = "; ".join(f"firm size {n}, paid {ev_text(x)}" for n, x in enumerate(amounts[:5]))
    return [([], "No matching records were found."), (many, f"7 matching rows (showing 5 of 7): {shown}."),
            ([{"calls_made": 31, "mean_length": 6.789, "best": None}], "calls made: 31; mean length: 6.79; best: None."),
            ([{"ref": "CO-00310", "name": "Quarz KG", "owner": None, "score": 12.5}], "1 matching rows: [CO-00310] Quarz KG, score 12.5.")]


def ev_text(x):
    short = f"{x:.2f}"
    return short[:-1] if short.endswith("0") else short


def test_summaries_say_what_the_rows_have_and_pass_the_audit(spark):
    items = [("", rows, None) for rows, _ in summaries()]
    answers, evidence = frames(spark, items)
    found = ev.summarize_rows(answers, evidence)
    got = {r.answer_id: r.summary for r in found.collect()}
    assert [got[f"a{i:03d}"] for i in range(len(items))] == [want for _, want in summaries()]
    texts = answers.drop("text").join(found.withColumnRenamed("summary", "text"), "answer_id")
    assert ev.audit_texts(texts.select("answer_id", "text", "question"), evidence).filter("NOT valid").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_real_text(spark, seed):
    rng = random.Random(seed)
    values = [round(rng.uniform(-1e5, 1e5), rng.randrange(6)) + 0.0001 for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.t for r in df.select("v", ev.real_text(F.col("v")).alias("t")).collect()} == {v: ev_text(v) for v in values}


def test_to_cells(spark):
    df = spark.sql("SELECT 'ISS-00907' AS issue, 41 AS n, 0.75D AS x, timestamp_ntz'2027-08-09 23:59:59' AS at, false AS b, array('CO-00011', 'no id') AS others, date'2027-08-10' AS day, cast(null as string) AS gone")
    got = [tuple(c) for c in df.select(ev.to_cells(df).alias("c")).first().c]
    assert got == [("issue", "ISS-00907", None, None), ("n", None, 41, None), ("x", None, None, 0.75), ("at", "2027-08-09 23:59", None, None),
                   ("b", None, None, None), ("others", "CO-00011", None, None), ("day", "2027-08-10", None, None), ("gone", None, None, None)]
