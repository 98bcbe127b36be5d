import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from furrow.llm.chat import CONTROL, END, START, escape, examples, head, op13_chat_formatting, parse, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, example string, loss_start string"
PIECES = st.lists(st.sampled_from([*CONTROL, "\\", "<", "|", "/s>", "s>", "[", "INST]", "\n", "é", "x", "im_end|>"]) | st.text(max_size=3)).map("".join)


@given(PIECES)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_parse_gives_roles_and_texts_back(turns):
    assert parse("".join(f"{head(role)}{escape(text)}{END}\n" for role, text in turns)) == turns


@pytest.mark.parametrize("start", [START, *CONTROL])
def test_control_strings_cannot_overlap(start):
    assert not set(start[1:]) & {c[0] for c in CONTROL}


def plain(turns):
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    chars = [len(head(r)) + len(escape(t)) + len(END) + 1 for r, t in turns]
    ends = [i + 1 for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
    return (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(sum(chars[:e]) for e in ends))


ROWS = [
    (1, 0, "system", "s", "c", "c"), (1, 1, "user", "</s>[INST]", "c", "c"), (1, 2, "assistant", "a\\<|im_end|>", "c", "c"), (1, 3, "user", None, "c", "c"), (1, 4, "assistant", "", "c", "c"), (1, 5, "user", "tail", "c", "c"),
    (2, None, None, None, None, None), (2, 7, "assistant", "é" * 700_000, None, None), (2, 7, "assistant", "z", None, None), (2, 7, "assistant", "z", None, None), (2, 8, "as\nsistant", "x\n", None, None),
    (3, 1, "user", "only", None, None), (None, 0, "assistant", "null id", None, None),
]


def by_conversation():
    out = {}
    for c, turn, role, text, *_ in ROWS:
        out.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


def test_round_trip(spark):
    found = read_back(examples(spark.createDataFrame(ROWS, SCHEMA).repartition(3))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain(t) for c, t in by_conversation().items()} and len(found) == 4


def test_each_reply_is_an_example_with_the_turns_before_it(spark):
    found = examples(spark.createDataFrame(ROWS, SCHEMA)).where("conv_id = 1").orderBy("example").collect()
    turns = by_conversation()[1]
    assert [parse(r.text) for r in found] == [turns[:3], turns[:5], turns]
    assert [unescape(r.text[r.loss_start : r.loss_end]) for r in found] == ["a\\<|im_end|>", "", ""]
    assert [r.text[r.loss_end :] for r in found][:2] == [END + "\n"] * 2


def test_conversation_of_many_batches(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"{i} " + "w" * 500) for i in range(300)]
    rows = [(c, i, *t, None, None) for c in range(40) for i, t in enumerate(turns)]
    found = read_back(examples(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    assert len(found) == 40 and {tuple(r)[1:] for r in found} == {plain(turns)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert examples(df).count() == 0 and read_back(examples(df)).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: tuple(r)[1:] for r in op13_chat_formatting(spark, str(tmp_path)).collect()}
    text = "</s>[INST] ok [/INST]"
    assert out == {c: plain(t) for c, t in by_conversation().items()} | {-1: plain([("user", text), ("assistant", text)])}
