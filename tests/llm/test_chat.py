from marlstone.llm import chat
from marlstone.llm.queries import ORACLE_SQL
from tests.oracle import rows

import duckdb


def both(spark, data):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' part", "1 pair_id", "2 occ", "'s' segment", "3 block", "4 side", "5 at")
    got = chat.preference_pairs(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    want = con.execute(ORACLE_SQL["op10_chat_formatting"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return got


def trained(row, part):
    return [row[part][slice(*map(int, span.split(":")))] for span in row[f"{part}_mask"].split(",") if span]


def test_prefix_once_then_both_sides(spark):
    same = [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]
    data = [(c, *t) for c in (4, 5) for t in same] + [(4, 3, "user", "x"), (4, 4, "assistant", "gööd"), (5, 3, "user", "y"), (5, 4, "assistant", "bad"), (5, 5, "user", "z"), (5, 6, "assistant", "")]
    (row,) = both(spark, data).to_dict("records")
    assert (row["pair_id"], row["chosen_id"], row["rejected_id"], row["paired"], row["prompt_turns"]) == (2, 4, 5, True, 3)
    assert row["prompt"] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in same)
    assert row["chosen"] == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\ngööd<|im_end|>\n"
    assert trained(row, "chosen") == ["gööd<|im_end|>\n"] and trained(row, "rejected") == ["bad<|im_end|>\n", "<|im_end|>\n"]


def test_odd_conversations(spark):
    last = 2**63 - 1
    data = [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"),  # equal
        (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "c"),  # one continues the other
        (6, 0, "assistant", "alone"), (9, 0, "user", "alone"),
        (10, 0, None, None), (11, 0, None, ""), (10, None, "user", "x"), (11, None, "user", "y"), (11, last, "user", "y"),
        (12, 0, "user", "b"), (12, 0, "user", "a"), (13, 0, "user", "a"), (13, 0, "user", "c"), (13, 0, "user", "c"),  # repeated turns
        (None, 0, "user", "n"), (None, 0, "user", "n"), (None, None, None, None),
        (-2, 0, "user", "m"), (-1, 0, "user", "k"), (14, -5, "user", "m"), (15, -5, "user", "m"),
        (20, 5, "user", "late"), (21, 0, "user", "early"), (21, 5, "user", "late"),
    ]
    got = both(spark, data)
    assert len(got[got.pair_id == 0]) == 1 and not got[got.pair_id == 0].chosen.any()
    assert set(got[got.pair_id.isin([3, 4])].paired) == {False} and set(got[~got.paired].chosen_mask) == {""}
    assert sorted(got[got.pair_id == 5].block.dropna()) == [0, last >> 10] and got[got.pair_id == 5].block.isna().sum() == 1


def test_long_conversations(spark):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t != 2500 or c else "other") for c in (0, 1) for t in range(3000)]
    data += [(c, 7, "user", f"r{i}") for c in (2, 3) for i in range(1500)]
    got = both(spark, data)
    assert list(got[got.pair_id == 0].sort_values("block").prompt_turns) == [1024, 1024, 452] and len(got[got.pair_id == 1]) == 2


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.preference_pairs(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
