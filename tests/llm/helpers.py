"""Small tables for the operators' tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; a table may have them too.
CLASHES = ["key", "hash", "size", "fingerprint", "component", "line", "host", "_key", "_hash", "_text", "block", "whole", "row", "_row", "ids"]


def docs(spark, rows):
    """A documents table of (doc_id, text, source), with further columns of clashing names."""
    full = [(i, t, "en", s, None if t is None else len(t), *[f"x{n}" for n in range(len(CLASHES))]) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS + "".join(f", `{c}` string" for c in CLASHES))


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
