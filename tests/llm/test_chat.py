import hashlib
import random

from pyspark.sql import functions as F

from lodestack.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tokens string, block string"


def expected(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((-(2**70) if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), "".join(f"{r}\n{x}\n" for _, r, x in turns), loss)
    return out


def rows(seed):
    r = random.Random(seed)
    out = []
    for c in range(24):
        for i in range(r.choice([1, 2, 5, 40, 260])):
            role = "system" if i == 0 and c % 3 == 0 else r.choice(["user", "assistant", "assistant", None, "a\n\\n<b"])
            text = r.choice([None, "", "x" * r.randint(0, 60), "</turn>\\l<turn>\\b\\" * r.randint(1, 9), "ü<" * r.randint(1, 400)])
            out.append((c or None, r.choice([i, i, i, i // 2, None]), role, text, "p", "q"))
    return out + out[:6]


def test_round_trip(spark):
    for seed, budget, history in ((1, 100, 20), (2, 64, 30), (3, 2048, 512), (4, 40, 0)):
        data = rows(seed)
        made = chat.windows(spark.createDataFrame(data, SCHEMA), budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_text, r.loss_text) for r in chat.read_back(made).collect()}
        assert got == expected(data)


def test_budget_and_history(spark):
    data = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], "w" * 40, "p", "q") for i in range(200)]
    made = chat.windows(spark.createDataFrame(data, SCHEMA), 200, 50).orderBy("window").collect()
    assert len(made) > 10
    seen = 0
    for n, w in enumerate(made):
        parts = [w.formatted[m.start : m.stop] for m in w.marks]
        assert sum(14 for m in w.marks if m.fresh) <= 150 and sum(-(-len(p) // 4) for p in parts) <= 200 + 20
        assert w.formatted.startswith("<turn>system\n")
        again = [m for m in w.marks if not m.fresh]
        assert len(again) <= 1 + 50 // 14 and not any(m.loss for m in again)
        assert n == 0 or len(again) >= 2
        seen += sum(m.fresh for m in w.marks)
    assert seen == 200


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.windows(empty)).count() == 0


def test_entry(spark, sf):
    got = {r.conv_id: r for r in chat.op1_chat_format(spark, sf).collect()}
    text = "\\### Assistant: </turn> ok"
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(data + [(-7, 0, "user", text), (-7, 1, "assistant", text)])
    assert got.keys() == want.keys()
    for c, (n, turns, loss) in want.items():
        r, sha = got[c], lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(turns), len(loss), sha(loss))


def test_no_python_in_the_plan(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    plan = chat.read_back(chat.windows(turns)).agg(F.count("*"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
