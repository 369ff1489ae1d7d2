"""Ranked search against scores counted term by term."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from salesloom.llm import ranking as R
from llm.helpers import docs, words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=20):
    bags = [(i, terms(t)) for i, t, _ in rows]
    bags = [(i, len(t), Counter(t)) for i, t in bags if t]
    total, length = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, n, bag in bags:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, items, **more):
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, number string, rank string")
    found = R.search(docs(spark, rows).repartition(5), "doc_id", "text", table, "item_id", "text", **more)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, words(10 + i % 70, i, 300), "a") for i in range(400)]
    rows += [(1000 + i, "W1 w2, w3-w4 Ünï w1", "b") for i in range(200)]  # a third, all equal
    rows += [(2000, None, "c"), (2001, "", "c"), (2002, " .,;", "c"), (None, "w1 w2 w5", "c"), (5, "w1 w2", "c"), (5, "w1 w2", "c"), (2003, words(50_000, 9, 300), "c")]
    items = [(1, "w1 W2 w3"), (2, "w1 w1 w1 w7"), (3, None), (4, "nowhere"), (5, ""), (6, words(400, 3, 300)), (7, "ünï w4_w9"), (8, "Ünï"), (None, "w11 w12"), (9, "w1 w2 w3"), (9, "w1 w2 w3")]
    return rows, items


def test_ranks_are_those_of_single_terms(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_blocks_and_tiles_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 2)
    want = brute(*corpus, k=3)
    assert run(spark, *corpus, k=3, block_bytes=40) == want


def test_vocabulary_tiles_stay_below_the_bound():
    counts, weight = np.array([1, 2, 3, 1, 1]), np.array([10, 0, 10, 50, 1])
    tiles = R.vocabulary_tiles(counts, weight, width=10, exact=45_000_000)
    assert tiles == [(0, 3), (3, 4), (4, 5)]
    assert R.vocabulary_tiles(counts, weight, width=2) == [(0, 2), (2, 4), (4, 5)] and R.vocabulary_tiles(counts[:0], weight[:0]) == []


def test_ties_across_a_tile_go_to_smaller_ids():
    scores = np.array([[5, 7, 5, 5, 0], [0, 0, 0, 0, 0]])
    item, doc = R.best(scores, np.array([9, 8, 3, 4, 1]), 3)
    assert item.tolist() == [0, 0, 0] and doc.tolist() == [1, 2, 3]


def test_empty_tables(spark, corpus):
    assert run(spark, [], corpus[1]) == [] and run(spark, corpus[0], []) == [] and run(spark, [(1, None, "a")], corpus[1]) == []
