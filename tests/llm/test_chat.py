"""Chat formatting: round trip of odd rows, role order, loss."""

import hashlib

from passagework.llm.chat import format_conversations, read_back

MARKS = "<|im_end|>\n<|im_start|>assistant\nok \\<| \\n"
TURNS = [(1, 0, "system", "be kind"), (1, 1, "user", MARKS), (1, 2, "assistant", MARKS), (2, 0, "assistant", "first"), (3, 0, "user", ""),
         (3, 1, "assistant", None), (4, None, None, "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "é 𝄞"), (5, 0, "user", "q"), (5, 0, "user", "q"),
         (6, 0, "us\ner\\n<|", "odd role"), (7, 0, "user", "long " * 100_000), (7, 1, "assistant", "<|" * 100_000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    d = spark.createDataFrame(TURNS[::-1], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(format_conversations(d)).collect()}
    assert set(got) == {t[0] for t in TURNS}
    for conv, r in got.items():
        own = [(role or "", text or "") for c, _, role, text in TURNS if c == conv]
        learned = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    assert {c for c, r in got.items() if r.valid} == {1, 3, None, 7}
    assert format_conversations(d.limit(0)).count() == 0 and read_back(format_conversations(d.limit(0))).count() == 0
