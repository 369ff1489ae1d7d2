"""Expectations come from how the rows are made: each pair by a known edit of a base record."""

import random
import string
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from salesloom.functions.similarity import _common_subsequence, affix_keys, all_pieces, indel_ratio, one_keystroke, ratio_pieces, reaching_ratio, typo_signatures
from salesloom.functions.text import fold, normalize_company, normalize_email, normalize_phone
from salesloom.operators import dedup
from salesloom.operators.dedup import classes, duplicate_edges, expand, find_duplicates, memberships, people

SCHEMA = ("lead_id string, company_id string, company_name string, first_name string, last_name string, "
          "email string, phone string, created_at timestamp_ntz")
START = datetime(2025, 6, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.lead_id, r.related_lead_id): r.reason for r in df.collect()}


def word(rng, size=9):
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(size))


class Records:
    """Base records far from each other, and edited copies of them."""

    def __init__(self, seed):
        self.rng, self.rows = random.Random(seed), []

    def add(self, base=None, **edit):
        n = len(self.rows)
        if base is None:
            first, last = word(self.rng).title(), word(self.rng).title()
            base = {"company_id": f"CO-{n}", "company_name": f"{word(self.rng)} Holding", "first_name": first, "last_name": last,
                    "email": f"{word(self.rng, 14)}@{word(self.rng)}.net", "phone": f"44{self.rng.randrange(10**8, 10**9)}"}
        row = {**base, **edit, "lead_id": f"LD-{n:05d}", "created_at": START + timedelta(hours=n)}
        self.rows.append(row)
        return row

    def frame(self, spark):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return frame(spark, [tuple(r[c] for c in names) for r in self.rows])


def other(rng):
    return {"email": f"{word(rng, 14)}@{word(rng)}.net", "phone": f"39{rng.randrange(10**8, 10**9)}"}


EDITS = {
    "same address": (lambda b, r: {"company_name": word(r), "first_name": word(r), "phone": None, "email": f"  {b['email'].upper()} "}, "same email ({email})"),
    "typo, phone": (lambda b, r: {**other(r), "last_name": b["last_name"][:-1] + "#", "phone": f"+{b['phone'][:3]} {b['phone'][3:]}"}, "matching name and same phone at same company"),
    "letters change places, no address": (lambda b, r: {**other(r), "first_name": b["first_name"][:3] + b["first_name"][4] + b["first_name"][3] + b["first_name"][5:], "email": None}, "matching name at same company, email missing on one record"),
    "fields change places": (lambda b, r: {**other(r), "first_name": b["last_name"], "last_name": b["first_name"], "email": " "}, "swapped first/last name at same company, email missing on one record"),
    "same name, phone": (lambda b, r: {**other(r), "phone": b["phone"], "first_name": b["first_name"].upper()}, "same name and same phone at same company"),
    "same name, other host": (lambda b, r: {**other(r), "email": b["email"].split("@")[0] + "@elsewhere.org"}, "same name and similar email (100) at same company"),
    "same name, one letter more in the address": (lambda b, r: {**other(r), "email": b["email"].replace("@", "x@")}, "same name and similar email (97) at same company"),
}
NO_EDITS = {
    "other company": lambda b, r: {"company_name": word(r), "company_id": "CO-X", **other(r), "phone": b["phone"]},
    "two typos": lambda b, r: {**other(r), "last_name": "##" + b["last_name"][2:], "phone": b["phone"]},
    "no evidence": lambda b, r: other(r),
    "no last name": lambda b, r: {**other(r), "last_name": None, "email": None},
}


@pytest.mark.parametrize("seed", [1, 2])
def test_each_known_edit_is_found_and_no_other(spark, seed):
    made, want = Records(seed), {}
    for edit, reason in EDITS.values():
        for _ in range(6):
            base = made.add()
            copy = made.add(base, **edit(base, made.rng))
            want[copy["lead_id"], base["lead_id"]] = reason.format(email=base["email"])
    for edit in NO_EDITS.values():
        for _ in range(6):
            base = made.add()
            made.add(base, **edit(base, made.rng))
    assert found(find_duplicates(made.frame(spark))) == want
    assert found(find_duplicates(made.frame(spark).repartition(5, F.rand(seed)))) == want
    assert found(expand(made.frame(spark), made.frame(spark))) == want


def test_every_member_of_a_bucket_takes_part_in_the_other_rules(spark):
    """Four records of one name: a nickname shares the phone of the third one only."""
    made = Records(3)
    base = made.add(first_name="Wilhelmina", last_name="Oakhurst", email="oakhurst@one.org", phone="4420000001")
    for n in (2, 3):
        made.add(base, email=f"oakhurst@number{n}.org", phone=f"442000000{n}")
    made.add(base, first_name="Wilhelmine", email="quite.another@five.org", phone="4420000003")
    got = found(find_duplicates(made.frame(spark)))
    assert got == {("LD-00001", "LD-00000"): "same name and similar email (100) at same company", ("LD-00002", "LD-00000"): "same name and similar email (100) at same company",
                   ("LD-00003", "LD-00002"): "matching name and same phone at same company"}


def test_buckets_have_one_link_for_each_member(spark):
    made = Records(4)
    mail = [made.add(email="desk@shared.org") for _ in range(9)]
    named = made.add(email=None, phone=None)
    bare = [named] + [made.add(named) for _ in range(5)]
    addressed = [made.add(named, **other(made.rng)) for _ in range(4)]
    got = found(find_duplicates(made.frame(spark)))
    assert set(got) == {(m["lead_id"], mail[0]["lead_id"]) for m in mail[1:]} | {(m["lead_id"], named["lead_id"]) for m in bare[1:] + addressed}
    chosen = spark.createDataFrame([(mail[4]["lead_id"],), (bare[2]["lead_id"],), (addressed[1]["lead_id"],)], "lead_id string")
    pairs = {tuple(sorted(p)) for p in found(expand(made.frame(spark), chosen))}
    want = {tuple(sorted((mail[4]["lead_id"], m["lead_id"]))) for m in mail if m is not mail[4]}
    want |= {tuple(sorted((bare[2]["lead_id"], m["lead_id"]))) for m in bare + addressed if m is not bare[2]}
    want |= {tuple(sorted((addressed[1]["lead_id"], m["lead_id"]))) for m in bare}
    assert pairs == want


def components(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_two_name_variants_give_rows_linear_in_the_records(spark):
    made = Records(8)
    rows = [made.add(first_name=("Bob", "Robert")[n % 2], last_name="Gonzalez", email=None, phone=None, company_id="CO-1", company_name="One") for n in range(120)]
    got = found(find_duplicates(made.frame(spark)))
    assert len(got) <= 2 * len(rows) and len(set(components(got, [r["lead_id"] for r in rows]).values())) == 1
    edges = duplicate_edges(made.frame(spark)).collect()
    assert {(e.kind_old, e.kind_new, e.members_old, e.members_new) for e in edges} == {("bare", "name", 60, 60), ("name", "bare", 60, 60)}


@pytest.mark.parametrize("seed", [11, 12])
def test_classes_join_what_all_pairs_join(spark, seed):
    """Few names, phones and addresses, so that all kinds of evidence cross; `expand` of all leads is the truth."""
    rng, made = random.Random(seed), Records(seed)
    for _ in range(90):
        first, last = rng.choice([("Bob", "Hale"), ("Robert", "Hale"), ("Rob", "Hale"), ("Hale", "Robert"), ("Bob", "Hales"), ("Ann", "Hale")])
        made.add(first_name=first, last_name=last, company_id=rng.choice(["CO-1", "CO-2"]), company_name=None, phone=rng.choice([None, "4420000001", "4420000002", "4420000003"]),
                 email=rng.choice([None, f"{rng.choice(['bob.hale', 'bob.hales', 'b.hale', 'robert.hale', 'quite.other'])}@{rng.choice(['one.org', 'two.org', 'three.org'])}"]))
    ids = [r["lead_id"] for r in made.rows]
    got, whole = found(find_duplicates(made.frame(spark))), found(expand(made.frame(spark), made.frame(spark)))
    assert got.items() <= whole.items() and components(got, ids) == components(whole, ids) and len(got) < len(whole)
    members = memberships(made.frame(spark)).groupBy("block", "first", "last", "kind", "value").count().collect()
    assert sorted(r["count"] for r in members) == sorted(r["members"] for r in classes(people(made.frame(spark))).collect())


@pytest.mark.parametrize("seed", [21])
def test_batches_keep_what_a_full_search_finds(spark, tmp_path, seed):
    from salesloom.operators import dedup_index
    rng, made, now = random.Random(seed), Records(seed), {}

    def some(row=None):
        first, last = rng.choice([("Bob", "Hale"), ("Robert", "Hale"), ("Hale", "Bob"), ("Ann", "Hales"), ("Ann", None)])
        edit = dict(first_name=first, last_name=last, company_id=rng.choice(["CO-1", "CO-2"]), company_name=None, phone=rng.choice([None, "4420000001", "4420000002"]),
                    email=rng.choice([None, f"{rng.choice(['bob.hale', 'bob.hales', 'other'])}@{rng.choice(['one.org', 'two.org'])}"]))
        return {**row, **edit} if row else made.add(**edit)

    def table(rows):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return frame(spark, [tuple(r[c] for c in names) for r in rows])
    now = {r["lead_id"]: r for r in (some() for _ in range(30))}
    root = str(tmp_path / "index")
    dedup_index.build(table(now.values()), root)
    for _ in range(3):
        changed = [some(now[i]) for i in rng.sample(sorted(now), 4)]
        gone = rng.sample(sorted(set(now) - {r["lead_id"] for r in changed}), 3)
        up = changed + [some() for _ in range(5)]
        now = {i: r for i, r in now.items() if i not in gone} | {r["lead_id"]: r for r in up}
        dedup_index.apply_batch(spark, root, table(up), spark.createDataFrame([(i,) for i in gone], "lead_id string"))
        assert found(dedup_index.duplicates(spark, root)) == found(find_duplicates(table(now.values())))
    dedup_index.apply_batch(spark, root, table([]), spark.createDataFrame([], "lead_id string"))
    assert found(dedup_index.duplicates(spark, root)) == found(find_duplicates(table(now.values())))


def test_a_very_large_bucket(spark):
    n = 100_000
    leads = spark.range(n).select(
        F.format_string("LD-%06d", "id").alias("lead_id"), F.lit("CO-1").alias("company_id"), F.lit(None).cast("string").alias("company_name"),
        F.lit("Ida").alias("first_name"), F.lit("Quist").alias("last_name"), F.lit("all@one.org").alias("email"), F.lit(None).cast("string").alias("phone"),
        F.lit(START).cast("timestamp_ntz").alias("created_at"))
    got = find_duplicates(leads)
    assert got.agg(F.count("*"), F.count_distinct("lead_id"), F.count_distinct("related_lead_id")).first()[:] == (n - 1, n - 1, 1)


@pytest.mark.parametrize(("a", "b", "same"), [
    (("kate", "moss"), ("katherine", "moss"), True), (("kate", "moss"), ("cathy", "moss"), False), (("Zoë", "Brontë"), ("zoe", "bronte"), True),
    (("olaf", "berg"), ("olaf", "borg"), True), (("eva", "berg"), ("ewa", "berg"), False), (("berg", "olaf"), ("olaf", "berg"), True),
    (("ted", "hayes"), ("edward", "hayse"), True), (("ulrich", "kant"), ("ulrike", "kant"), False), (("nora", "field"), ("nora", "fields"), True),
])
def test_names(spark, a, b, same):
    made = Records(5)
    base = made.add(first_name=a[0], last_name=a[1], email=None)
    made.add(base, first_name=b[0], last_name=b[1])
    assert bool(found(find_duplicates(made.frame(spark)))) == same


def test_normalizers(spark):
    cases = [
        (fold, {"Ångström  Öl": "angstrom ol", "\u2460 ℡": "1 tel", "\tA\u00a0B ": "a b", "日本": "", None: ""}),
        (normalize_email, {" Ada.Byron+x@GoogleMail.com": "adabyron@gmail.com", "Ada.Byron+x@Work.com": "ada.byron+x@work.com", " \t": None, "plain": "plain@", None: None}),
        (normalize_company, {"Zeta Works, Inc.": "zeta works", "ZETA-WORKS Ltd": "zeta works", "The Öko GmbH": "the oko", "Co. Ltd": ""}),
        (normalize_phone, {"(030) 90-18 20": "030901820", "0049 30 9018 2012": "3090182012", "12-34-56": None, None: None}),
    ]
    for rule, values in cases:
        df = spark.createDataFrame([(t,) for t in values], "t string")
        assert {r.t: r.v for r in df.select("t", rule(F.col("t")).alias("v")).collect()} == values


def test_one_edit_is_a_keystroke_and_shares_a_signature(spark):
    rng, near, far = random.Random(6), [], []
    for _ in range(600):
        a = word(rng, rng.randint(4, 9))
        i = rng.randrange(len(a))
        j = rng.randrange(len(a) - 1)
        near += [(a, a[:i] + "#" + a[i + 1:]), (a, a[:i] + "#" + a[i:]), (a, a[:j] + a[j + 1] + a[j] + a[j + 2:])]
        far += [(a, "##" + a), (a, "#" + a[1:-1] + "#")]
    df = spark.createDataFrame([(a, b, True) for a, b in near] + [(a, b, False) for a, b in far], "a string, b string, near boolean")
    a, b = F.col("a"), F.col("b")
    wrong = df.select("*", one_keystroke(a, b).alias("is"), F.arrays_overlap(typo_signatures(a), typo_signatures(b)).alias("sig"), F.arrays_overlap(affix_keys(a), affix_keys(b)).alias("affix"))
    assert wrong.filter("is <> near OR (near AND NOT (sig AND affix))").collect() == []


def test_alike_texts_share_a_piece(spark):
    """`kept` letters of `size` stay: the ratio is 2 x kept by all letters of both."""
    rng, rows = random.Random(7), []
    for _ in range(1500):
        a = word(rng, rng.randint(3, 16))
        gone = rng.randint(0, min(3, len(a) - 1))
        at = sorted(rng.sample(range(len(a)), len(a) - gone))
        b = "".join(a[i] for i in at)
        more = rng.randint(0, 3)
        for _ in range(more):
            i = rng.randint(0, len(b))
            b = b[:i] + "#" + b[i:]
        rows.append((a, b, 200.0 * (len(a) - gone) / (len(a) + len(b))))
    df = spark.createDataFrame(rows, "a string, b string, ratio double")
    a, b = F.col("a"), F.col("b")
    got = df.select("*", indel_ratio(a, b).alias("is"), F.arrays_overlap(ratio_pieces(b), all_pieces(a)).alias("piece"))
    assert got.filter("abs(is - ratio) > 1e-9 OR (ratio >= 85 AND NOT piece)").collect() == []


# ------------------------------------------------------------------ crowds

def test_local_parts_that_begin_alike_make_no_edges_unless_they_reach_the_ratio(spark):
    parts = [f"person{n * 7919 % 1_000_000:06d}" for n in range(60)]
    leads = _crowd(spark, [("Ann", "Lee", f"{p}@x.com") for p in parts])
    persons = dedup.people(leads)
    edges = dedup.class_edges(dedup.classes(persons), dedup.matching_names(persons)).filter("kind_old = 'mail'").select("value_old", "value_new").collect()
    alike = {(a, b) for i, a in enumerate(parts) for b in parts[i + 1:] if (1 - (24 - 2 * _common_subsequence(a, b)) / 24) * 100 >= 85}
    assert len(edges) == len(alike) and {tuple(r) for r in edges} == alike


def _crowd(spark, people):
    rows = [(f"LD-{n:05d}", "CO-1", first, last, email, datetime(2024, 1, 1) + timedelta(minutes=n)) for n, (first, last, email) in enumerate(people)]
    return spark.createDataFrame(rows, "lead_id string, company_id string, first_name string, last_name string, email string, created_at timestamp_ntz")


@pytest.mark.parametrize("limits", [{"FEW_NAMES": 0, "FEW_MEETINGS": 0, "BLOCK_CLASSES": 3}, {"FEW_NAMES": 10**6, "FEW_MEETINGS": 10**6}])
def test_blocks_and_joins_find_the_same(spark, monkeypatch, limits):
    dice = random.Random(5)
    names = [("Robert", "Gonzalez"), ("Bob", "Gonzales"), ("Jose", "Lee"), ("Joe", "Lee"), ("Lee", "Joe"), ("Katherine", "Novak")]
    people = [(*dice.choice(names), dice.choice([None, f"{dice.choice(['bob.gonzalez', 'j', 'x' * 70])}{dice.randrange(60)}@x.com"])) for _ in range(70)]
    leads = _crowd(spark, people)
    want = sorted(map(tuple, dedup.find_duplicates(leads).collect()))
    for name, value in limits.items():
        monkeypatch.setattr(dedup, name, value)
    assert want and sorted(map(tuple, dedup.find_duplicates(leads).collect())) == want


def test_reaching_ratio_finds_all_pairs_of_any_length():
    dice = random.Random(1)
    texts = ["".join(dice.choice("abé1") for _ in range(dice.choice([0, 1, 3, 8, 15, 63, 64, 65, 90]))) for _ in range(40)]
    others = texts[:20] + [t[:-1] + "b" for t in texts]

    def ratio(a, b):
        return (1 - (len(a) + len(b) - 2 * _common_subsequence(a, b)) / (len(a) + len(b))) * 100 if a + b else 100.0
    found = {(int(i), int(j)) for i, j in zip(*reaching_ratio(texts, others, 85))}
    assert found == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(others) if ratio(a, b) >= 85}
