import random

from pyspark.sql import functions as F

from millrace.llm import chat

PIECES = ["### ", "###", "#", "\\", "</turn>", "</turn>\n", "<part/>", "<", ": ", ":", "\n", "assistant", "é", "", "ok", "\\#", "\\\\", "turn>"]


def back(df):
    return df.select("conv_id", "n_blocks", "formatted", "segments", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))


def test_control_strings_come_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys: ###", "a\\b:", ""]), "".join(rng.choices(PIECES, k=rng.randrange(9)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    out = {r.conv_id: r for r in back(chat.format_chats(spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string"))).collect()}
    for c, r in out.items():
        mine = [(role, text) for i, _, role, text in rows if i == c]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.loss == "".join(text for role, text in mine if role == "assistant")
        assert r.n_blocks == 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))
        assert r.formatted == "".join(s.text for s in r.segments)


def test_null_repeated_tied_long_and_empty(spark):
    long = "x\\### " * 50_000
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "assistant", long)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in back(chat.format_chats(table)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", "first"), ("user", ""), ("user", ""), ("assistant", "a"), ("assistant", "b")]
    assert out[1].loss == "ab" and out[1].n_blocks == 3
    assert out[None].loss == long and len(out[None].turns) == 1
    assert chat.format_chats(table.limit(0)).count() == 0


def test_plan_is_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = back(chat.format_chats(table))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
