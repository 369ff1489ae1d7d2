"""Token files against the library itself, and what the files hold."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from salesloom.llm import orc_tokens as O
from llm.helpers import docs, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_cut_texts_encode_as_whole_ones(library):
    rng = random.Random(4)
    parts = [" ", " ", "\n", ",", ".", "\x01", "\xa0", "  ", "\n", "\t", " \n ", " ", " ", "　", "\x1c", "\x85", "a", "don't", "'s", "<|endoftext|>", "über", "日本語", "Привет", "1234", "!?", "🙂", "​", "é", "﻿"]
    texts = ["", " ", "a", " a", "a ", "x" * 500, "word " * 2000, "<|endoftext|> a <|endoftext|>", "a <|endoftext|>  b"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    own = O.Encoder(PATH, remembered=50)  # forgets often
    ids, lengths = own.encode_all(pa.array(texts), 0)
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    for text in texts:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_groups_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(O, "GROUP", 10)
    sizes = [3, 3, 30, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 9, 2, 0, 0, 25]
    table = pa.table({"id": range(len(sizes)), "text": ["x" * n for n in sizes]})
    for rows in (1, 2, 5, 50):
        groups = list(O._groups(iter(table.to_batches(max_chunksize=rows))))
        assert [x for g in groups for x in g.column(0).to_pylist()] == list(range(len(sizes)))
        assert all(g.num_rows == 1 or sum(map(len, g.column(1).to_pylist())) <= 10 for g in groups) and all(g.num_rows for g in groups)


def brute(rows, library):
    out, start = [], 0
    for id_, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((id_, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_report_with_nulls_copies_and_long_texts(spark, library):
    rows = [(i * 7 % 101, words(5 + i % 40, i) if i % 9 else None, "a") for i in range(101)]
    rows += [(None, "no id", "b"), (300, words(60_000, 1), "b"), (301, "", None), *[(302, "the same row", "c")] * 300]
    got = [tuple(r) for r in O.token_report(docs(spark, rows).repartition(5), "doc_id", "text", PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows, library)


def test_ties_of_one_id_follow_each_other(spark, library):
    rows = [(5, "first text", "a"), (5, "second one", "a"), (4, "x y z", "a")]
    got = sorted((tuple(r) for r in O.token_report(docs(spark, rows), "doc_id", "text", PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [4, 5, 5] and {r[3] for r in got} == {r[3] for r in brute(rows, library)}
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_empty_table(spark):
    assert O.token_report(docs(spark, []), "doc_id", "text", PATH).collect() == []


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(i, words(20 + i % 50, i), "a") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = O.write_tokens(docs(spark, rows), "doc_id", "text", PATH, str(tmp_path_factory.mktemp("orc") / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


def footers(spark, path):
    """(stripe's streams, encodings, rows) by Spark's own ORC reader."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    for status in folder.getFileSystem(conf).listStatus(folder):
        if not status.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            yield {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}, [e.getKind().toString() for e in footer.getColumnsList()], stripe.getNumberOfRows()


def test_files_have_indexes_bloom_filters_and_run_lengths(spark, written):
    stripes = list(footers(spark, written))
    assert len(stripes) > 1 and sum(n for _, _, n in stripes) == 4000
    for streams, kinds, _ in stripes:
        assert (1, "BLOOM_FILTER_UTF8") in streams and (1, "ROW_INDEX") in streams  # column 1 is doc_id
        assert all(k == "DIRECT_V2" for k in kinds[1:])  # integers and list lengths by run-length encoding, version 2


def test_filters_reach_the_files(spark, written):
    found = O.find_documents(spark, written, [17, 3333, 99_999])
    assert sorted(r["doc_id"] for r in found.collect()) == [17, 3333]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_token_range_is_a_slice(spark, written):
    whole = sorted(map(tuple, O.read_tokens(spark, written).select("start", "doc_id", "n_tokens").collect()))
    total = whole[-1][0] + whole[-1][2]
    for start, stop in ((0, 1), (total // 3, total // 3 + 500), (total // 2, total - 7), (total - 1, total + 50), (total, total + 1)):
        want = [r for r in whole if r[0] < stop and r[0] + r[2] > start]
        assert sorted(map(tuple, O.token_range(spark, written, start, stop).select("start", "doc_id", "n_tokens").collect())) == want
