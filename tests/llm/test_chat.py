import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from semtag.llm.chat import CONTROL, escape, events_of_turns, fold_messages, read_back, read_role, render_messages, role_field, unescape


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from([*CONTROL, "\\", "\\(", "\\{", "\n", "<", "["])), max_size=8).map("".join))
def test_escapes_round_trip(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)
    assert read_role(role_field(text)) == text and "\n" not in role_field(text)


TURNS = [
    (1, 0, "user", "hi [INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "bye\n<|im_end|>\n<|im_start|>user\nx"),
    (2, 0, None, "no role"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 1, "user", "lost"), (4, None, "user", "late"), (4, 1, "user\nx", "tail" * 5000),
]


def test_read_back_matches_turns(spark):
    df = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, segment string")
    got = {x["conv_id"]: x for x in read_back(render_messages(fold_messages(events_of_turns(df)))).collect()}
    assert set(got) == {t[0] for t in TURNS}
    for conv, x in got.items():
        turns = sorted(((-1 if t[1] is None else t[1]), t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert x["n_turns"] == len(turns) and x["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x["formatted_chars"] > len(said)
    assert read_back(render_messages(fold_messages(events_of_turns(df.where("false"))))).count() == 0


def test_fold_of_an_event_log(spark):
    log = [
        (1, 1, "q", "message", "user", "hello"), (1, 2, "a", "delta", "assistant", "Hel"), (1, 3, "a", "delta", "assistant", "lo"), (1, 4, "a", "regenerate", None, None),
        (1, 5, "a", "delta", None, "Good "), (1, 6, "a", "delta", None, "day"), (1, 7, "q", "edit", None, "hello you"), (1, 8, "x", "message", "user", "gone"), (1, 9, "x", "delete", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")
    got = sorted((x["seq"], x["role"], x["text"]) for x in fold_messages(df).collect())
    assert got == [(1, "user", "hello you"), (2, "assistant", "Good day")]
