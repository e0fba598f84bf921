import hashlib
import json
import random

import duckdb

from gradelake.llm import chat_format as C

SF = "/root/testdata/sf0.01"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(2)
    bits = [*C.CONTROL, "\\", "\\\\", "<", "[", "/", "s>", "|im_end|>", "\n", "$1", "é", "😀", "", "INST]", "<|im_start", "assistant\n"]
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "odd role\n<s>", "assistant "]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))))
    rows += [rows[0], (None, None, "assistant", "x"), (500, None, "user", "first"), (500, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    formatted = C.format_turns(C.canonical_turns(df))
    back = {x.conv_id: x for x in C.read_back(formatted).collect()}
    got = {x.conv_id: x for x in C.digests(C.read_back(formatted)).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(x.role, x.text) for x in back[c].turns] == [x[1:] for x in own]
        loss = "".join(x[2] for x in own if x[1] == "assistant")
        assert back[c].loss == loss
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), sha(loss))
        assert got[c].turns_sha256 == sha("".join(f"{b}\n{t}\n" for _, b, t in own))
        inner = back[c].formatted.replace(C.OPEN, "").replace(C.CLOSE, "")
        assert not any(x in inner for x in C.CONTROL)
        assert back[c].formatted.count(C.OPEN) == back[c].formatted.count(C.CLOSE) == len(own)
    assert C.digests(C.read_back(C.format_turns(C.canonical_turns(df.limit(0))))).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": None}, {"role": "gpt", "content": "a", "x": 1}]}, "messages", [("system", "s"), ("user", ""), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 4}, "from_value", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "p", "response": "r", "meta": {"prompt": 1}}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": 7}, "prompt_completion", [("user", "p"), ("assistant", "7")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction_input_output", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input_output", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"instruction": "i", "output": None}, "instruction_output", [("user", "i"), ("assistant", "")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"messages": []}, "no_messages", []),
        ({"nothing": 1}, None, []),
        ([1, 2], None, []),
    ]
    rows = [(i, json.dumps(x)) for i, (x, _, _) in enumerate(records)] + [(100, None), (101, "{bad")]
    got = {x.conv_id: x for x in C.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert (got[i].layout, [tuple(t) for t in got[i].turns]) == (layout, turns)
    assert got[100].layout is None is got[101].layout and got[101].turns == []
    lists = spark.createDataFrame([(1, [("user", "u"), (None, None)], 0), (2, None, 0)], "conv_id long, messages array<struct<role:string,content:string>>, z int")
    assert [[tuple(t) for t in x.turns] for x in C.canonical_turns(lists).orderBy("conv_id").collect()] == [[("user", "u"), ("", "")], []]


def test_sql_and_plan(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = C.op1_chat_format(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(C.OP1_SQL).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_messages_that_lack_a_field(spark):
    rows = [
        (1, {"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", ""), ("assistant", "b")]),
        (2, {"messages": [{"content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("", "a"), ("assistant", "")]),
        (3, {"messages": [{"role": "user", "text": "a"}, {"role": "gpt", "content": "b"}]}, "messages_mixed", [("user", "a"), ("assistant", "b")]),
        (4, {"conversations": [{"from": "human"}, {"from": "gpt", "value": "y"}]}, "from_value", [("user", ""), ("assistant", "y")]),
        (8, {"messages": ["hi", {"role": "user", "content": "x"}, 4, None, [1]]}, "messages", [("", ""), ("user", "x"), ("", ""), ("", ""), ("", "")]),
        (9, {"conversations": [{}, {"from": "gpt", "value": "y"}, [], "z"]}, "from_value", [("", ""), ("assistant", "y"), ("", ""), ("", "")]),
        (10, {"messages": ["hi"]}, "no_messages", []), (11, {"messages": [{"role": ["r"], "content": {"a": 1}}, {"role": "user", "content": "x"}]}, "messages", [None, ("user", "x")]),
        (5, {"messages": [{"role": "user"}]}, None, []), (6, {"messages": "none"}, "no_messages", []), (7, {"messages": []}, "no_messages", []),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x, _, _ in rows], "conv_id long, record string")
    got = {x.conv_id: (x.layout, [(t.role, t.text) for t in x.turns]) for x in C.turns_of_records(df).collect()}
    assert got.pop(11)[1][1:] == [("user", "x")]  # fields that are no texts do not fail
    assert got == {i: (layout, turns) for i, _, layout, turns in rows if i != 11}
