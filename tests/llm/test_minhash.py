import importlib
import itertools
import random

import numpy as np

from llm.helpers import CLASHES, docs, rows_of, words
from salesloom.llm import minhash


def shingle_set(text):
    found = (text or "").lower().split()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)} or {tuple(found)}


def kept_by_rule(rows):
    """By all pairs: the smallest id of each component of five-word Jaccard 0.8 or more."""
    sets, least = {i: shingle_set(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return sorted(set(least.values()))


def edited(text, n, rng):
    out = text.split()
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def planted():
    """Pairs of 40 to 600 words with edits that leave similarities of about 0.6 to 1, and texts without a near copy."""
    rng, rows = random.Random(7), []
    for i in range(60):
        base = words(rng.randrange(40, 600), 100 + i, 10**6)
        rows += [(2 * i, base, "a"), (2 * i + 1, edited(base, max(1, round(len(base.split()) * rng.uniform(0, 0.04))), rng), "a")]
    return rows + [(200, None, "a"), (201, " ", "a"), (202, "one two", "a"), (203, "ONE  two", "b"), (204, "two one", "a")]


def test_stage_removes_planted_near_copies(spark, sf_dir):
    rows = planted()
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["simhash_dedup"]
    got = [r.doc_id for r in stage(spark, docs(spark, rows), sf_dir).select("doc_id").collect()]
    want = kept_by_rule(rows)
    assert sorted(got) == want and 65 < len(want) < 120  # some pairs are near copies, some are not


def test_crowds_equal_all_pairs(spark):
    rng = random.Random(9)
    base = words(200, 1, 10**6)
    rows = [(i, edited(base, rng.choice((2, 4, 6)), rng), "a") for i in range(60)]  # many pairs are under 0.8; others join them
    rows += [(100, base, "a")]
    far = words(300, 2, 10**6)
    rows += [(200 + i, edited(far, 8, rng), "a") for i in range(40)]  # alike, but all pairs are under 0.8 or near it
    got = minhash.drop_near_copies(docs(spark, rows), "doc_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == kept_by_rule(rows)


def test_rounds_reach_members_that_the_first_ones_miss(spark):
    """A chain in one key: each text is near to its neighbours only, so the first of the crowd is near to two."""
    rng = random.Random(3)
    own = words(400, 5, 10**6).split()
    rows = []
    for i in range(40):
        rows.append((i, " ".join(own), "a"))
        for at in rng.sample(range(200, 400), 3):
            own[at] = f"n{rng.randrange(10**9)}"
    table = docs(spark, rows)
    each = minhash.signatures(table, "text", minhash.F.col("doc_id")).select("doc", minhash.F.expr("array(1L)").alias("keys"), "sketch").distinct()
    sets = [shingle_set(t) for _, t, _ in rows]
    assert 5 * len(sets[0] & sets[-1]) < 4 * len(sets[0] | sets[-1])
    assert len({r.root for r in minhash.roots_of(table, "text", each).collect()}) == 1


def test_columns_and_ties(spark):
    rows = [(5, words(80, 1), "a"), (3, words(80, 1), "a"), (9, words(80, 1).replace("w", "W"), "a"), (2, None, None), (7, "", "b"),
            (None, words(50, 3), "c"), (None, words(50, 3), "c"), (4, words(30_000, 5), "c"), (4, words(30_000, 5), "c")]
    table = docs(spark, rows)
    kept = minhash.drop_near_copies(table, "doc_id", "text")
    assert kept.columns == table.columns
    assert [r[0] for r in rows_of(kept, "doc_id", *[f"`{c}`" for c in CLASHES[:2]])] == sorted([2, 3, 4, None], key=lambda i: repr((i,)))
    assert minhash.drop_near_copies(docs(spark, []), "doc_id", "text").collect() == []


def test_least_hashes_agree_as_often_as_shingles():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    met = 0
    for i in range(200):
        rng.shuffle(s)
        met += bool(set(minhash.band_keys(minhash.least_hashes(s[:900]))) & set(minhash.band_keys(minhash.least_hashes(s[100:]))))  # 0.8
    assert met == 200
