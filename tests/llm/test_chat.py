import hashlib

from lodestone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["</s>", r"\<|end|>", "a\\", "<|turn|>user\n<|text|>\nx\n<|end|>\n", "[INST]\n\n[/INST]\\\\", "<<SYS>>", "", None, "ünï 🙂 <|text|>"]


def test_examples_hold_context_and_one_reply(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>"), (1, 2, "user", "r"), (1, 3, "assistant", "b")], SCHEMA)
    got = chat.expand(df).orderBy("target").collect()
    assert [r.target for r in got] == [2, 4]
    for r, want in zip(got, [r"a\</s>", "b"]):
        assert r.formatted[r.loss_start : r.loss_start + r.loss_chars] == want
    assert got[1].formatted.startswith(got[0].formatted)


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in (1, 2) for t, x in enumerate(HARD[c - 1 :])] + [(3, 0, None, "s"), (3, None, "we<|text|>ird", "<s>"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c in (1, 2, 3, 4):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", "z")], SCHEMA + ", formatted string")
    assert chat.expand(df).collect()[0].loss_start is None
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_very_long_texts_and_a_conversation_without_an_id(spark):
    long = "a </s> b\\ [INST] é " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long[:-7]), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (None, 1, "assistant", "r")]
    got = {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {1, None} and got[None].n_turns == 3 and got[None].loss_chars == 2
    assert got[1].loss_chars == len(long) - 7 and got[1].loss_sha256 == hashlib.sha256(long[:-7].encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long[:-7]}\n".encode()).hexdigest()
