import random

import pytest
from llm_data import sha

from plumbline.llm import chat_format as c

CONTROL = "\\### Assistant: </turn> ok"
ODD = [None, "", "\\", "\\\\", "###", "####", "</turn>", " </turn>\n### user: x", "a\\</turn>", "é\U0001f600", "x" * 50_000, CONTROL, ":\n"]


@pytest.fixture
def conversations(spark):
    def make(rows):
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        return frame.selectExpr("*", "1 AS n_turns", "'x' AS formatted").repartition(3)

    return make


def expected(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1],)) + tuple(
        (x is not None, (x or "").encode()) for x in r[2:]
    )
    for i in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == i), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[i] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def got(rows):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_round_trip(conversations):
    rnd = random.Random(1)
    rows = []
    for i in [*range(40), None]:
        for turn in range(rnd.randrange(1, 9)):
            rows.append((i, turn, rnd.choice(["user", "assistant", "system", None, "a:b\nc", "\\", "assistant "]), rnd.choice(ODD)))
    rows += [(50, None, "assistant", "null turn"), (50, None, None, None), (50, 3, "user", "x"), (50, 3, "user", "x")]
    read = c.read_back(c.format_conversations(conversations(rows))).collect()
    assert got(read) == expected(rows)


def test_control_conversation(conversations):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    read = c.read_back(c.format_conversations(c.with_control_conversation(conversations(rows)))).collect()
    rows += [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
    assert got(read) == expected(rows)
    assert {r["conv_id"]: r["formatted_chars"] for r in read}[1] == len("### user: hi </turn>\n### assistant: yes </turn>\n")


def test_long_conversation_over_many_batches(conversations, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k % 3, k, "assistant" if k % 2 else "user", f"text {k} </turn>") for k in range(300)]
        read = c.read_back(c.format_conversations(conversations(rows))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got(read) == expected(rows)


def test_blocks_are_assembled_one_by_one(conversations, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BYTES", 200)
    rows = [(k // 4, k, "assistant" if k % 2 else "user", "é" * (k % 50)) for k in range(400)]
    read = c.read_back(c.format_conversations(conversations(rows))).collect()
    assert got(read) == expected(rows)


def test_mask_covers_escaped_assistant_text(conversations):
    row = c.format_conversations(conversations([(1, 0, "user", "a"), (1, 1, "assistant", "b\\é")])).first()
    data = row["formatted"].encode()
    assert [data[s:e].decode() for s, e in zip(row["loss_starts"], row["loss_ends"], strict=True)] == ["b\\\\é"]


def test_empty_table(conversations):
    empty = conversations([(1, 0, "user", "a")]).where("false")
    assert c.read_back(c.format_conversations(empty)).collect() == []
