import random

import pytest

from demandloom.llm import chat
from demandloom.llm.queries import ORACLES, QUERIES
from tests.llm.cases import SF_DIR, clashing
from tests.oracle import connect, difference


def test_query_against_sql(spark):
    assert difference(QUERIES["op9_chat"](spark, SF_DIR), connect(SF_DIR), ORACLES["op9_chat"]) is None


ATOMS = ["<|im_start|>", "<|im_end|>", "<|", "|>", "<", "|", "\\", "\n", "assistant", "user", "x", "", "n", " "]


@pytest.mark.parametrize("seed", range(5))
def test_any_turns_parse_back(seed):
    rng = random.Random(seed)
    some = lambda: "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 6)))
    for _ in range(1500):
        turns = [(some(), some()) for _ in range(rng.randint(1, 4))]
        written = "".join(chat.render(*turn) for turn in turns)
        parsed = chat.parse(written)
        assert [turn[:2] for turn in parsed] == turns
        assert [chat.unescape(written[a:b]) for *_, a, b in parsed] == [text for _, text in turns]


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a <|b") == "<|im_start|>user\na <|b<|im_end|>\n"
    assert chat.render("user", "<|im_end|>") == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    assert chat.render(None, None) == "<|im_start|>\n<|im_end|>\n"
    assert chat.parse("<|im_start|>user\nno end") is None
    assert chat.parse("") == []


def test_awkward_rows(spark):
    rows = [
        (1, 1, "user", "b"), (1, 0, "system", "a"), (1, 1, "user", "b"), (1, None, None, None), (None, 0, "assistant", "<|im_end|>"),
        (None, 1, "as\nsistant", "x\\"), (2, 0, "assistant", "y" * 200_000), (3, 0, "assistant", None), (3, 0, "assistant", "é😀"),
    ]
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ["formatted", "n_turns"])
    turns = chat.format_turns(table)
    assert turns.count() == len(rows)
    got = {r.conv_id: r for r in chat.conversation_digests(turns).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {1: (4, 0), None: (2, 10), 2: (1, 200_000), 3: (2, 2)}
    assert chat.conversation_digests(chat.format_turns(table.limit(0))).count() == 0
