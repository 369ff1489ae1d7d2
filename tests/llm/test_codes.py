"""Vector codes against rounds in plain Python, with hot, repeated and unusable rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from salesloom.llm import codes as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, row bigint, position int, entry int, _id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    """(id, label, code, error) of the kept rows in order, the codebooks, and the members that moved in each round."""
    kept = [(i, [np.float32(x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        firsts.setdefault(i, v)
    starts = [v for _, v in sorted(firsts.items())][:entries]
    length = len(starts[0])
    starts = [v for v in starts if len(v) == length]
    kept = [r for r in kept if len(r[1]) == length]
    width = -(-length // parts)

    def cut(v):
        numbers = [math.floor(4096 * float(x)) for x in v] + [0] * (parts * width - length)
        return [numbers[p * width:(p + 1) * width] for p in range(parts)]

    members = [cut(v) for _, v, _ in kept]
    books = [[cut(v)[p] for v in starts] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(m[p], books[p][e]), e)) for p in range(parts)] for m in members]
    moved, before = [], None
    for _ in range(rounds):
        own = assign()
        if before:
            moved.append(sum(a != b for x, y in zip(own, before) for a, b in zip(x, y)))
        before = own
        for p in range(parts):
            for e in range(len(books[p])):
                got = [m[p] for m, o in zip(members, own) if o[p] == e]
                if got:
                    books[p][e] = [sum(x) // len(got) for x in zip(*got)]
    own = assign()
    out = [(i, l, "".join(f"{e:02x}" for e in o), sum(far(m[p], books[p][o[p]]) for p in range(parts))) for (i, _, l), m, o in zip(kept, members, own)]
    return out, books, moved


def sample():
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(400)]
    hot = [0.25] * 16
    rows += [(1000 + i, hot, 1) for i in range(250)]  # a third of all rows
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2), (8, [0.5] * 16, None), (None, rows[3][1], 1)]
    rows += [(2000, None, 1), (2001, [None] * 16, 1), (2002, [float("nan")] * 16, 2), (2003, [float("inf")] + [0.0] * 15, 2), (2004, [1.0] * 8, 1), (2005, [], 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_partition", [100, 400_000])
def test_codes_are_those_of_plain_rounds(spark, per_partition):
    rows = sample()
    want, books, moved = brute(rows)
    passed = []
    got, own = C.train(table(spark, rows).repartition(3), "vec_id", "embedding", ["label"], per_partition=per_partition, watched=passed)
    found = [(r["vec_id"], r["label"], "".join(f"{e:02x}" for e in r["code"]), r["error"]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in own] == books
    assert passed == moved and moved[-1] < moved[0]


def test_members_stay_in_place(spark):
    books = [np.array([[0], [10]])]
    key = lambda e, s: (0, e, s)
    blocks = [(key(0, s), (np.arange(s * 256, s * 256 + 3), np.array([[0], [1], [9]]))) for s in range(6)]
    lloyd = C.Lloyd(spark.sparkContext.parallelize(blocks), books, 4, 2)
    place = lambda: sorted((i, *r) for i, rs in enumerate(lloyd.residents.map(lambda b: (b[0][1], b[1][0].tolist())).glom().collect()) for r in rs)
    before = {(row, at) for at, entry, rows in place() for row in rows}
    assert sum(len(b[1][0]) for b in lloyd.migrate().collect()) == 6 and lloyd.residents.getNumPartitions() == 4
    after = place()
    stayed = {(row, at) for at, entry, rows in after for row in rows if entry == 0}
    assert stayed <= before and len(stayed) == 12
    assert all(at == (1 + (row // 256)) % 4 for at, entry, rows in after for row in rows if entry == 1)


def test_report_sums_by_label(spark):
    rows = sample()
    want, books, _ = brute(rows)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    got = C.code_report(table(spark, rows), "vec_id", "embedding", "label").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, c, e, sums[l], sha) for i, l, c, e in want), key=repr)


def test_few_ids_odd_lengths_and_large_components(spark):
    rows = [(1, [1.0, 2.0, 3.0], None), (2, [5.0, -6.0, 7.5], None), (2, [5.0, -6.0, 7.0], 4)]
    want, books, _ = brute(rows, parts=2)
    got, own = C.train(table(spark, rows), "vec_id", "embedding", [], parts=2)
    assert sorted((r["vec_id"], "".join(f"{e:02x}" for e in r["code"]), r["error"]) for r in got.collect()) == sorted((i, c, e) for i, _, c, e in want)
    large = C.code_report(table(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]), "vec_id", "embedding", "label").collect()
    assert len(large) == 3 and all(r["error"] >= 0 for r in large)


def test_nothing_to_code(spark):
    assert C.code_report(table(spark, []), "vec_id", "embedding", "label").collect() == []
    assert C.code_report(table(spark, [(None, [1.0], 1), (1, None, 2)]), "vec_id", "embedding", "label").collect() == []
