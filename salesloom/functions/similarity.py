"""Edit-distance predicates and the signatures that find candidates for them."""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers need no copy of this package: the Arrow function travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_TYPO_LENGTH = 4


def adjacent_swap(a: Column, b: Column) -> Column:
    """True when swapping two neighbouring letters turns `a` into `b`."""
    def swapped_at(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)),
                        F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    size = F.length(a)
    hit = F.exists(F.sequence(F.lit(1), size - 1), lambda i: swapped_at(i) == b)
    return F.when((size == F.length(b)) & (size >= 2) & (F.levenshtein(a, b, 2) == 2), hit).otherwise(F.lit(False))


def one_keystroke(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or neighbour swap, the longer name having four letters or more."""
    long_enough = F.greatest(F.length(a), F.length(b)) >= MIN_TYPO_LENGTH
    return long_enough & ((F.levenshtein(a, b, 1) >= 0) | adjacent_swap(a, b))


def typo_signatures(name: Column) -> Column:
    """The name and, for four letters or more, every spelling with one letter left out.

    Two names that `one_keystroke` accepts always share a signature, so an equi-join on signatures
    misses no pair.
    """
    dropped = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    short = F.array(name)
    return F.when(F.length(name) >= MIN_TYPO_LENGTH, F.array_distinct(F.concat(short, dropped))).otherwise(short)


def affix_keys(name: Column) -> Column:
    """First two and last two letters, plus the outer letters of a four-letter name.

    One keystroke touches only one end of a name of five letters or more; in a four-letter name a swap
    in the middle leaves the outer letters. So names that `one_keystroke` accepts share a key here too:
    fewer and coarser keys than `typo_signatures`, for groups of bounded size.
    """
    head = F.concat(F.lit("<"), F.substring(name, 1, 2))
    tail = F.concat(F.lit(">"), F.substring(name, -2, 2))
    outer = F.when(F.length(name) == 4, F.concat(F.lit("="), F.substring(name, 1, 1), F.substring(name, -1, 1)))
    return F.filter(F.array(head, tail, outer), lambda k: k.isNotNull())


def ratio_pieces(text: Column) -> Column:
    """Two-letter pieces of which at least one survives in every text with an indel ratio of 85 or more.

    Such a partner lies within 0.15 * (la + lb) insertions and deletions and has at most 1.15 / 0.85
    times the length, so at most floor(la * 0.3 / 0.85) operations apart. Each of them breaks at most one
    of the disjoint pieces, so one piece more than that is enough. Texts of up to three letters have too
    few pieces and share one common key with the short partners they can have.
    """
    size = F.length(text)
    needed = F.floor(size * 30 / 85).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), needed - 1), lambda i: F.substring(text, i * 2 + 1, F.lit(2)))
    return F.when(size <= 3, F.array(F.lit("short"))).otherwise(F.array_distinct(cut))


def all_pieces(text: Column) -> Column:
    """Every two-letter piece, the counterpart of `ratio_pieces`."""
    size = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(text, i, F.lit(2)))
    pieces = F.when(size >= 2, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))
    return F.concat(pieces, F.when(size <= 4, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")))


def may_reach_ratio(a: Column, b: Column, percent: float) -> Column:
    """Cheap necessary condition for `indel_ratio(a, b) >= percent`, from the plain edit distance."""
    total = F.length(a) + F.length(b)
    return F.levenshtein(a, b) * F.lit(100.0) <= F.lit(100.0 - percent) * total


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence with one bit per letter of `a`."""
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & where.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity 0..100 from insertions and deletions only; NULL when a side is NULL."""
    for left, right in batches:
        scores = []
        for a, b in zip(left, right):
            if a is None or b is None:
                scores.append(None)
                continue
            total = len(a) + len(b)
            gap = total - 2 * _common_subsequence(a, b)
            scores.append((1 - gap / total) * 100 if total else 100.0)
        yield pd.Series(scores, dtype="float64")


def _common_subsequences(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all texts of both sides; those on the left have up to 64 letters, a bit for each."""
    place = {letter: k for k, letter in enumerate(sorted(set("".join(left))))}
    masks = np.zeros((len(left), len(place) + 1), np.uint64)  # the last column stands for letters that the left does not have
    for i, text in enumerate(left):
        for bit, letter in enumerate(text):
            masks[i, place[letter]] |= np.uint64(1 << bit)
    letters = np.full((max(map(len, right), default=0), len(right)), len(place))
    for j, text in enumerate(right):
        letters[:len(text), j] = [place.get(letter, len(place)) for letter in text]
    row = np.full((len(left), len(right)), ~np.uint64(0))
    for column in letters:
        hit = row & masks[:, column]
        row = (row + hit) | (row - hit)  # bits beyond the text stay set
    return np.bitwise_count(~row).astype(np.int64)


def reaching_ratio(left: list[str], right: list[str], percent: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of all pairs of texts whose `indel_ratio` may be `percent` or more: all that are, and rounding errors."""
    sizes = [np.array([len(t) for t in side], np.int64) for side in (left, right)]
    common = np.zeros((len(left), len(right)), np.int64)
    x, y = np.nonzero(sizes[0] <= 64)[0], np.nonzero(sizes[1] <= 64)[0]
    long_x, long_y = np.nonzero(sizes[0] > 64)[0], np.nonzero(sizes[1] > 64)[0]
    if len(x):
        common[x] = _common_subsequences([left[i] for i in x], right)
    if len(long_x) and len(y):
        common[np.ix_(long_x, y)] = _common_subsequences([right[j] for j in y], [left[i] for i in long_x]).T
    for i in long_x:
        for j in long_y:
            common[i, j] = _common_subsequence(left[i], right[j])
    total = sizes[0][:, None] + sizes[1][None, :]
    return np.nonzero((total - 2 * common) * 100 <= (100 - percent) * total + 1e-6)
