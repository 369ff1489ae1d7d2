import importlib

import pytest

from llm.helpers import docs, words

LINE = "All rights reserved by the source"


def planted(block, seed):
    """A source of 400 documents: a line on 20 and a block on 40 of them, copies and near copies of two others, a rare line."""
    rows, far = [], 10**6 * seed
    for i in range(300):
        text = "\n".join(words(8, far + 10 * i + k, 10**6) for k in range(4))
        text += f"\n {LINE}\t" if i < 20 else "\n" + "\n".join(block) if i < 60 else "\nrare line" if i < 68 else ""
        rows.append((i, text, "wide"))
    copy, near = ("\n".join(words(9, far + part + k, 10**6) for k in range(12)) for part in (5000, 6000))
    rows += [(300 + i, copy, "wide") for i in range(60)]
    rows += [(400 + i, near.replace(near.split("\n")[i % 12], words(9, far + 7000 + i, 10**6)), "wide") for i in range(40)]
    rows += [(500 + i, f"{words(9, far + 8000 + i)}\n{LINE}", "other") for i in range(8)]
    # No source is one, too; nothing of it repeats often enough. Empty, missing and very long texts stay as they are.
    rows += [(600 + i, f"{words(9, far + 9000 + i)}\n{LINE}", None) for i in range(9)]
    return rows + [(700, None, "wide"), (701, "", "wide"), (702, "\n\n", None), (703, words(30_000, seed), "wide"), (704, "\n".join(block), "wide"), (704, "\n".join(block), "wide")]


@pytest.mark.parametrize(("lines", "seed"), [(1, 1), (3, 2), (20, 3), (20, 4), (20, 5)])
def test_source_boilerplate_goes_and_copies_stay(spark, sf_dir, lines, seed):
    block = [f"Menu item {k} of {seed}" for k in range(lines)]
    rows = planted(block, seed)
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["line_dedup"]
    got = {r.doc_id: r for r in stage(spark, docs(spark, rows), sf_dir).select("doc_id", "text", "n_chars").collect()}
    bad = {LINE, *block}
    for i, text, source in rows:
        want = text if text is None else "\n".join(x for x in text.split("\n") if source != "wide" or x.strip(" \t\r") not in bad)
        assert (got[i].text, got[i].n_chars) == (want, None if want is None else len(want)), i


def test_no_documents(spark, sf_dir):
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["line_dedup"]
    assert stage(spark, docs(spark, []), sf_dir).collect() == []
