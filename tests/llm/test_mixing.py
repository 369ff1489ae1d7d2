import hashlib
import random

import pytest

from llm.helpers import docs, rows_of, words
from salesloom.llm import mixing


def filled(sizes, percent=150, cap=2):
    """Water-filling by exact fractions over (source, size)."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = Fraction(sum(sizes.values()) * percent, 100), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_by_exact_fractions(spark, seed):
    rng = random.Random(seed)
    sizes = {f"é{i}" if i % 2 else f"Z{i}": rng.choice([0, 3, 50, 700, 20_000]) for i in range(9)} | {None: 40}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = filled(sizes)
    for source, target in rows_of(got, "source", "target"):
        assert target == pytest.approx(float(want[source])), source


def test_every_source_comes_near_its_target(spark):
    rng = random.Random(5)
    rows = [(i, words(rng.choice([1, 5, 40, 300]), i), rng.choice(["a", "a", "b", "c", "d", None])) for i in range(600)]
    rows += [(900, "", "a"), (901, None, "b"), (902, "same", "b"), (902, "same", "b"), (None, words(30, 9), "c"), (None, words(20, 8), "c"), (903, words(1_500, 7), "d")]
    table = docs(spark, rows)
    first = rows_of(mixing.mix_report(table, "doc_id", "text", "source").withColumn("t", mixing.F.col("taken")), "doc_id", "size", "source_size", "target", "taken")
    assert first == rows_of(mixing.mix_report(table.repartition(7), "doc_id", "text", "source"), "doc_id", "size", "source_size", "target", "taken")
    assert [(i, n) for i, n, *_ in first] == sorted(((i, len((t or "").split())) for i, t, _ in rows), key=repr)
    taken, target = {}, {}
    for _, size, total, goal, got in first:
        assert got in (0, size, 2 * size)
        taken[total] = taken.get(total, 0) + got
        target[total] = goal
    for total in taken:
        assert abs(taken[total] - target[total]) <= max(5, 0.01 * target[total])
    mixed = mixing.mix(table, "doc_id", "text", "source")
    assert mixed.columns == table.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_the_cut_follows_the_hash_order(spark):
    rows = [(i, words(10, i), "a") for i in range(40)] + [(100 + i, words(10, i), "b") for i in range(40)]
    got = {r.doc_id: r.taken // r.size for r in mixing.mix_report(docs(spark, rows), "doc_id", "text", "source").collect()}
    for start in (0, 100):
        in_order = sorted(range(start, start + 40), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest())
        counts = [got[i] for i in in_order]
        assert counts == sorted(counts, reverse=True)


def test_nothing_to_mix(spark):
    assert mixing.mix_report(docs(spark, []), "doc_id", "text", "source").collect() == []
    empty = mixing.mix_report(docs(spark, [(1, "", "a"), (2, None, None)]), "doc_id", "text", "source")
    assert rows_of(empty, "size", "target", "taken") == [(0, 0.0, 0), (0, 0.0, 0)]
    assert mixing.mix(docs(spark, []), "doc_id", "text", "source").collect() == []
