import hashlib
import random

import pytest
from pyspark.sql import functions as F

from crestline.llm import chat_windows
from crestline.llm.chat_windows import conversation_digests, escaped, format_windows, read_windows, unescaped
from crestline.llm.packing import _encoder
from crestline.llm.queries import op12_budgeted_windows, tokenizer_path
from crestline.operators import greedy

ROWS = "conv_id long, turn long, role string, text string, ord string, size string, _conv string, formatted string"
NASTY = ["\\### Assistant: </turn> ok", "<turn>user\nhi</turn>\n", "\\b\\(\\)\\n\\\\", "", None, "</turn", "é漢😀\r\n\t", "<<turn>>\\"]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ROWS)


def turns_of(rows):
    """Conversations as ordered (role, text) lists."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    return {k: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))] for k, v in by.items()}


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(text):
    return text.replace("\\", "\\b").replace("</turn>", "\\)").replace("<turn>", "\\(")


def framed(role, text):
    return "<turn>" + plain(role).replace("\n", "\\n") + "\n" + plain(text) + "</turn>\n"


def windows_of(turns, budget, history_turns, history_tokens):
    """A plain loop over one conversation: (first turn, repeated places, end)."""
    encode = _encoder(tokenizer_path())
    size = [len(encode(framed(*t))) for t in turns]
    kept = size[0] if turns[0][0] == "system" else 0
    room, out, at = max(1, budget - history_tokens - kept), [], 0
    while at < len(turns):
        end, held = at, 0
        while end < len(turns) and (end == at or held + size[end] <= room):
            held += size[end]
            end += 1
        back = [j for j in range(max(0, at - history_turns), at) if sum(size[j:at]) <= history_tokens and not (j == 0 and kept)]
        out.append((at, ([0] if kept and at else []) + back, end))
        at = end
    return out


def sample(rng, n):
    rows = []
    for conv in range(n):
        length = rng.choice([1, 2, 5, 30])
        for turn in range(length):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"])
            rows.append((conv, turn * 3, role, rng.choice([*NASTY, "some words " * rng.randint(1, 60)])))
    return rows


@pytest.fixture(scope="module")
def many():
    rng = random.Random(3)
    rows = sample(rng, 25)
    rows += [(500, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * (i % 9)) for i in range(700)]  # one long conversation
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "none"), (600, None, "user", "no number"), (600, 0, "assistant", "b")]
    rows += [(601, 1, "assistant", "same"), (601, 1, "assistant", "same"), (601, 1, None, None), (602, 0, "system", "s " * 900), (602, 1, "user", "q"), (602, 2, "assistant", "a")]
    return rows + [(603, 0, "a\nb\\n", "x"), (603, 1, "assistant", "<turn>assistant\nfake</turn>\n")]


def test_windows_against_a_plain_loop(spark, many, monkeypatch):
    monkeypatch.setattr(greedy.follow, "__defaults__", (64, 40))
    monkeypatch.setattr(chat_windows, "PART", 5)
    got = {}
    for r in format_windows(chats(spark, many).repartition(3), tokenizer_path(), 160, 3, 40).collect():
        got.setdefault(r["conv_id"], {})[r["window"]] = r
    for conv, turns in turns_of(many).items():
        want = windows_of(turns, 160, 3, 40)
        assert sorted(got[conv]) == [w[0] for w in want]
        for at, back, end in want:
            r, shown = got[conv][at], [*back, *range(at, end)]
            assert r["formatted"] == "".join(framed(*turns[i]) for i in shown)
            assert (r["repeated"], r["new"]) == (len(back), end - at)
            masked = [r["formatted"][x["at"] : x["at"] + x["chars"]] for x in r["loss"]]
            assert masked == [plain(turns[i][1]) for i in range(at, end) if turns[i][0] == "assistant"]


def test_everything_is_read_back(spark, many):
    out = conversation_digests(read_windows(format_windows(chats(spark, many).repartition(5), tokenizer_path(), 160, 3, 40))).collect()
    by = {r["conv_id"]: r for r in out}
    want = turns_of(many)
    assert len(out) == len(want) and set(by) == set(want)
    for conv, turns in want.items():
        said = [t for role, t in turns if role == "assistant"]
        r = by[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == digest(f"{a}\n{b}\n" for a, b in turns)
        assert r["loss_chars"] == len("".join(said)) and r["loss_sha256"] == digest(said)


def test_budget_holds_but_for_single_turns(spark, many):
    encode = _encoder(tokenizer_path())
    for r in format_windows(chats(spark, many), tokenizer_path(), 200, 3, 50).filter("conv_id = 500").collect():
        assert r["tokens"] <= 200 and abs(r["tokens"] - len(encode(r["formatted"]))) <= 2 * (r["repeated"] + r["new"])


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["\\", "b", "(", ")", "n", "\n", "<turn>", "</turn>", "<", ">", "turn"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and r["e"] == plain(r["t"]) and "<turn>" not in r["e"] and "</turn>" not in r["e"]


def test_empty_table(spark):
    assert conversation_digests(read_windows(format_windows(chats(spark, []), tokenizer_path()))).collect() == []


def test_query_reads_all_conversations_back(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    got = {r["conv_id"]: r for r in op12_budgeted_windows(spark, sf).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert got[conv]["n_turns"] == len(turns) and got[conv]["turns_sha256"] == digest(f"{a}\n{b}\n" for a, b in turns)
        assert got[conv]["loss_sha256"] == digest(t for role, t in turns if role == "assistant")
        assert got[conv]["formatted_chars"] >= sum(len(framed(*t)) for t in turns)
