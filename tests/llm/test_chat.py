import hashlib
from collections import defaultdict

from graphloom.llm import chat, queries

HARD = r"\### Assistant: </turn> ok"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def digest(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_whole_table_and_hard_conversation(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    assert digest(queries.op9_chat_format(spark, sf)) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "####### \\\\ </turn></turn>"), (1, 1, "assistant", "\\"), (1, 1, "assistant", "\\"), (1, 2, None, None), (1, None, "user", "first"),
        (2, 0, "assistant", ""), (3, 0, "a: b\n### c", "x\n### assistant: y</turn>\n"), (None, 0, "assistant", "é😀" * 1000), (4, 5, "assistant", "0"), (4, 6, "assistant", "1"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, n_turns int")
    got = chat.read_back(chat.formatted(df))
    assert digest(got) == expected(rows)
    assert not any(r.rewrites_history for r in got.collect())
    assert chat.formatted(df.limit(0)).count() == 0


def test_template_that_rewrites_history_is_seen():
    class Numbered(chat.MarkedTurns):
        def render(self, turns):
            return f"[{len(turns)}]" + super().render(turns)

    out, spans, rewrites = chat.locate(Numbered().render, [("user", "a"), ("assistant", "bb"), ("user", "ccc")])
    assert rewrites and [out[s.text_start : s.text_end] for s in spans] == ["a", "bb", "ccc"]
    out, spans, rewrites = chat.locate(chat.MarkedTurns().render, [("user", "0"), ("assistant", "11")])
    assert not rewrites and [out[s.text_start : s.text_end] for s in spans] == ["0", "11"]
