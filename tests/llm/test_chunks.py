import hashlib
import random

import numpy as np

from llm.helpers import docs, rows_of, words
from salesloom.llm import chunks


def step_by_step(raw):
    h, out = 0, []
    for b in raw:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_hashes_follow_the_recurrence():
    raw = bytes(random.Random(1).randrange(256) for _ in range(500))
    assert chunks.gear_hashes(np.frombuffer(raw, np.uint8)).tolist() == step_by_step(raw)


def test_borders_follow_the_rule_in_blocks_too(monkeypatch):
    raw = words(3000, 2).encode()
    h, start, want = step_by_step(raw), 0, []
    while start < len(raw):
        end = len(raw)
        for n in range(chunks.SMALLEST, min(chunks.LARGEST, len(raw) - start) + 1):
            bits = chunks.HARD_BITS if n < chunks.WANTED else chunks.EASY_BITS
            if n == chunks.LARGEST or h[start + n - 1] < 1 << (32 - bits):
                end = start + n
                break
        want.append(end)
        start = end
    assert chunks.borders(raw) == want
    monkeypatch.setattr(chunks, "_BLOCK", 777)
    assert chunks.borders(raw) == want


def test_an_insertion_changes_few_chunks():
    text = words(2000, 3)
    one, two = chunks.chunk_set(text.encode()), chunks.chunk_set((text[:4000] + " something new " + text[4000:]).encode())
    assert chunks.containment(one, two) > 0.95 and chunks.containment(one, chunks.chunk_set(words(2000, 4).encode())) < 0.1
    assert chunks.unpack(chunks.pack(one)) == one


ROWS = [(i, words(30 + 7 * i, i), "a") for i in range(60)] + [(3, words(40, 99), "b"), (61, None, "a"), (62, "", "a"), (63, "é日😀" * 41, None), (None, "last one", "a"), (None, None, "a"), (64, words(40_000, 5), "a")]




def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(chunks, "PER_RANGE", 7)  # several ranges
    table = docs(spark, ROWS)
    order = [r for r in table.select("doc_id", "text", chunks.F.xxhash64("text").alias("h")).collect()]
    order.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        own, following = r.text or "", after.text or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + following[:half]
        a, b, c = (chunks.chunk_set(x.encode()) for x in (own, edited, following))
        want.append((r.doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), chunks.pack(a), chunks.pack(b), chunks.containment(a, b), chunks.containment(a, c)))
    got = chunks.edited_fingerprints(table, "doc_id", "text")
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_fingerprints_alone_equal(spark):
    table = docs(spark, ROWS)
    alone = {(r.doc_id, r.fingerprint) for r in chunks.fingerprints(table, "doc_id", "text").collect()}
    assert alone == {(r.doc_id, r.fingerprint) for r in chunks.edited_fingerprints(table, "doc_id", "text").collect()}


def test_one_row_no_row_and_repeated_rows(spark):
    assert chunks.edited_fingerprints(docs(spark, []), "doc_id", "text").collect() == []
    (one,) = chunks.edited_fingerprints(docs(spark, [(1, "abcd", "a")]), "doc_id", "text").collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    same = chunks.edited_fingerprints(docs(spark, [(1, "abcd", "a")] * 5), "doc_id", "text").collect()
    assert len(same) == 5 and len({r.edited_sha256 for r in same}) == 1
