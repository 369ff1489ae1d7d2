import pytest

from llm.helpers import rows_of
from salesloom.llm import chat

ROWS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> there"), (1, 2, "bob b", ""), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, None, "who"), (2, None, "eve", "é😀"),
        (None, 0, "ann", "x"), (3, 0, "system", "alone"), (4, 0, "ann", "y" * 200_000)]


def by_rule(rows):
    out = []
    for conv, turn, role, text in rows:
        for person in {r for c, _, r, _ in rows if c == conv and r not in (None, "system")}:
            own = role == person
            content = (text or "").replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
            name = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in role or "")
            head = "assistant" if own else "system" if role == "system" else f"user name={name}" if name else "user"
            text_out = f"<|im_start|>{head}\n{content}<|im_end|>\n"
            start = len(f"<|im_start|>{head}\n")
            out.append((conv, person, turn, head.split()[0], text_out, *((start, start + len(content) + 10) if own else (0, 0))))
    return sorted(out, key=repr)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, speaker string, conv int")


def test_every_perspective(table):
    got = chat.rotate(table)
    assert rows_of(got, *got.columns) == by_rule(ROWS)


def test_masks_cover_content_and_end(table):
    for r in chat.rotate(table).where("mask_end > 0").collect():
        assert r.speaker == "assistant" and r.rendered[r.mask_start:r.mask_end].endswith("<|im_end|>") and r.rendered[:r.mask_start] == "<|im_start|>assistant\n"


def test_plan_has_no_python(table):
    plan = chat.rotate(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, table):
    assert chat.rotate(table.limit(0)).collect() == []
