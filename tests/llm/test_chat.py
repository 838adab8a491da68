import hashlib

from hypothesis import given
from hypothesis import strategies as st

from ondula.llm import chat

T = chat.Template()


def digest(turns):
    under = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest()


@given(st.lists(st.sampled_from([*T.control, "\\", "[", "</", "x", "é", " ", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text
    assert not any(c in escaped for c in T.control)


def test_round_trip_and_order(spark):
    convs = {1: [("system", "s"), ("user", "a [INST] \\ </s>"), ("assistant", "b\\[/INST]")], 2: [("user", None), ("assistant", "")],
             3: [("assistant", "x"), ("user", "y")], 4: [("tool", "t [TEXT] u"), (None, "z")], 5: [("user", "é" * 100000), ("assistant", "ok"), ("user", "more")]}
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string").repartition(4)
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    texts = {}
    spans = {}
    for r in sorted(formatted.collect(), key=lambda r: (r.conv_id, r.step)):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.formatted
        spans.setdefault(r.conv_id, []).extend(r.loss)
    assert texts[2] == "<s>[INST]  [/INST][ANS] </s>"
    for c, text in texts.items():
        assert got[c].formatted_chars == len(text)
        assert "".join(T.unescape(text[s.start:s.end]) for s in spans[c]) == "".join(t or "" for r, t in convs[c] if r == "assistant")
        assert [(r, t) for r, t, _ in T.read(text)] == [(r or "", t or "") for r, t in convs[c]]


def test_edges(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, None, None, None), (None, 1, "user", "a"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "b")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert got[None].n_turns == 2
    assert (got[3].n_turns, got[3].turns_sha256) == digest([("assistant", "b"), ("user", "same"), ("user", "same")])[:2]
    assert not got[3].valid
