"""Chat formatting: round trips of ids and text, masks, digests; nulls, empty and long texts, ties,
repeated rows, an empty table and clashing extra columns."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from washkit.llm import chat_format as C

AWKWARD = ["", "\\", "\\\\", "### ", "\\### Assistant: </turn> ok", "</turn>\n### user: hi</turn>\n", "a\\</turn>", "x\\\\</turn>\\", "<|endoftext|>", "####  </turn></turn>", "é 漢字 🙂\x00\n", ": ", "</tur</turn>"]


def codec():
    with open(C.TOKENIZER, "rb") as f:
        return C.Codec(f.read())


@given(st.lists(st.sampled_from(["\\", "### ", "</turn>", "</turn>\n", ": ", "#", "<", "<|endoftext|>", "a", "\n", "user"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert C.unescape(C.escape(text)) == text
    roles = C.CONTROLS + C.ROLE_CONTROLS
    assert C.unescape(C.escape(text, roles), roles) == text
    assert C.parse(C.render("user", text) + C.render(text, "b") + C.render("assistant", text)) == [("user", text), (text, "b"), ("assistant", text)]


def test_ids_are_read_back_and_only_marks_are_reserved():
    c = codec()
    turns = [(r, t) for r in ("user", "assistant", "", "### x: ") for t in AWKWARD]
    trained = [r == "assistant" for r, _ in turns]
    ids, mask, begins = c.assemble(turns, trained)
    assert c.read(ids) == turns
    assert (ids >= c.turn).sum() == 3 * len(turns) and not mask[ids >= c.turn].any()
    assert c.trained_texts(ids, mask) == [t for r, t in turns if r == "assistant" and t]
    assert list(np.flatnonzero(ids == c.turn)) == list(begins[:-1]) and begins[-1] == len(ids)


def test_a_segment_is_encoded_on_its_own():
    c = codec()
    ids, _, _ = c.assemble([("user", "hello"), ("assistant", " world")], [False, True])
    assert list(ids) == [c.turn, *c.encode("user"), c.role_end, *c.encode("hello"), c.turn_end, c.turn, *c.encode("assistant"), c.role_end, *c.encode(" world"), c.turn_end]


ROWS = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, None, "x"), (1, 4, "assistant", "tie"), (1, 4, "assistant", "tie"), (1, None, "system", "first"),
        (None, 0, "assistant", "no id"), (2, 0, "assistant", "word " * 60000), (2, 1, "user", "x" * 150000), *[(3, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(AWKWARD)]]


def test_conversations(spark):
    df = spark.createDataFrame([(*r, "e", 7, 8) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, position int, ids int").repartition(4)
    chat = C.format_conversations(df)
    got = {r.conv_id: r for r in C.read_back(chat, in_order=True).collect()}
    again = {r.conv_id: r for r in C.read_back(chat).collect()}
    assert got == again and len(got) == 4
    for conv in got:
        own = [(t, r or "", x or "") for i, t, r, x in ROWS if i == conv]
        own = [(r, x) for _, r, x in sorted(own, key=lambda o: (o[0] is not None, o[0] or 0, C.render(*o[1:]).encode()))]
        loss = "".join(x for r, x in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(C.render(*o)) for o in own)
        rows = sorted((x for x in chat.collect() if x.conv_id == conv), key=lambda x: x.position)
        assert [x.position for x in rows] == list(range(len(own)))
        assert [x.token_start for x in rows] == [0, *np.cumsum([len(x.ids) for x in rows])[:-1]]
        assert C.parse("".join(x.formatted for x in rows)) == own
        assert all(len(x.ids) == len(x.loss_mask) for x in rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_conversations(df)).collect() == []


def test_other_tokens_than_reserved_are_required(spark):
    with pytest.raises(ValueError):
        C.parse("### user: never ended")
