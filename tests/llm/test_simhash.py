import itertools
import re

import numpy as np
import pytest
import xxhash

from llm.helpers import CLASHES, docs, rows_of, words
from salesloom.llm import simhash
from salesloom.llm.components import components


def by_rule(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints):
    """By all pairs: the smallest id reachable over links of two bits or fewer."""
    least = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(prints, 2):
            if (x ^ y).bit_count() <= 2 and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.mark.parametrize("text", ["", " \t", "One", "É B", "a b c d\x0be\x1cf", "same same same same", "x " * 40_000])
def test_fingerprint_follows_the_rule(text):
    assert simhash.fingerprint(text.encode()) == by_rule(text)


@pytest.mark.parametrize("width", [21, 22])
def test_words_at_distance_two_share_a_codeword(width):
    rng = np.random.default_rng(width)
    for _ in range(300):
        a = b = int(rng.integers(0, 1 << width))
        for bit in rng.choice(width, int(rng.integers(0, 3)), replace=False):
            b ^= 1 << int(bit)
        keys = [set(simhash.golay_keys(np.array([x]), width)[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1] and len(keys[0]) in (1, 6)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5), (7, None)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "root"))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert got == want


def test_links_equal_all_pairs_also_in_crowds(spark):
    rng = np.random.default_rng(4)
    values = set()
    for _ in range(30):  # chains of near words
        x = int(rng.integers(0, 1 << 63))
        for _ in range(4):
            values.add(x)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(bit)
    center = int(rng.integers(0, 1 << 63))  # a crowd in one bucket, of which some are three or four bits apart
    values |= {center ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(20, 24)} | {center ^ (7 << 30), center ^ (15 << 40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.classes(spark.createDataFrame([(v, v) for v in signed], "fingerprint bigint, id bigint"), simhash.F.col("id"))
    first = dict(rows_of(got, "fingerprint", "first"))
    assert first == smallest_reachable([(v, v & (1 << 64) - 1) for v in signed])


ROWS = [(5, words(80, 1), "a"), (3, words(80, 1), "a"), (9, words(80, 1).replace("w", "W"), "a"), (1, words(80, 2), "b"), (2, None, None),
        (7, "", "b"), (8, " \n ", "b"), (None, words(50, 3), "c"), (None, words(50, 3), "c"), (None, words(50, 4), "c"), (4, words(30_000, 5), "c"),
        (4, words(30_000, 5), "c"), (6, "one two", "a")]


def test_query_columns(spark):
    got = rows_of(simhash.near_duplicates(docs(spark, ROWS), "doc_id", "text"), "doc_id", "fingerprint", "component_id")
    want = {3: 3, 5: 3, 9: 3, 1: 1, 2: 2, 7: 2, 8: 2, 4: 4, 6: 6, None: None}
    assert got == sorted(((i, f"{by_rule(t):016x}", want[i]) for i, t, _ in ROWS), key=repr)


def test_one_document_of_each_group_stays(spark):
    table = docs(spark, ROWS)
    kept = simhash.drop_near_duplicates(table, "doc_id", "text")
    assert kept.columns == table.columns
    got = rows_of(kept, "doc_id", "text", *[f"`{c}`" for c in CLASHES[:2]])
    assert [r[0] for r in got] == sorted([1, 2, 3, 4, 6, None, None], key=lambda i: repr((i,))) and len({r[1] for r in got}) == 7


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, []), "doc_id", "text").collect() == []
    assert simhash.drop_near_duplicates(docs(spark, []), "doc_id", "text").collect() == []
