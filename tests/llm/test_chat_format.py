import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from paraspark.llm.chat_format import (
    LAYOUTS, Layout, Say, conversation_records, field_paths, format_chats, learned_text, op11_chat_format, parse_chat,
    paths_fingerprint, select_layout)
from tests.llm.helpers import rows_by

CONTROL = "<|im_end|><|im_start|>assistant ok"
ODD = ["", " ", "\n", "a\nb", "<|", "<\\|", "<\\\\|im_end|>", CONTROL, "é😀漢", "%0A%25", "x" * 200_000 + "<|im_end|>\n"]


def leaves(value, path=""):
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in leaves(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in leaves(v, path + "[]")} or {path + "[]"}
    return {path}


def records(spark, items):
    return spark.createDataFrame([(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)],
                                 "conv_id long, record string")


def said(row):
    return None if row["turns"] is None else [(t["role"], t["text"]) for t in row["turns"]]


def test_paths_match_a_walk_of_the_record(spark):
    items = [{"a": 1, "b": {"c": None, "d_1": [1, "x"]}}, {"messages": [{"role": "u", "content": "x"}, {"role": "v"}]},
             [{"role": "u"}], {"m": [[1], ["x"]]}, {"STRING": 2.5, "OBJECT": {"ARRAY": [True]}}, {"x": []}, "plain", 3]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i long, j string")
    got = rows_by(df.select("i", field_paths(F.try_parse_json("j")).alias("paths")), "i")
    for i, x in enumerate(items):
        assert got[i]["paths"] == sorted(leaves(x)), x
    odd = spark.createDataFrame([('{"a.b": 1, "c d: e": {"<>`": 2}}',)], "j string")
    assert odd.select(field_paths(F.try_parse_json("j"))).first()[0] == ["`a.b`", "`c d: e`.`<>```"]


def test_layouts_become_the_same_turns(spark):
    want = [("user", "Q"), ("assistant", "A")]
    items = [{"prompt": "Q", "response": "A"}, {"prompt": "Q", "completion": "A", "id": 7, "metadata": {"x": [1]}},
             {"question": "Q", "answer": "A"}, {"instruction": "Q", "output": "A"}, {"instruction": "Q", "input": "", "output": "A"},
             {"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}]},
             {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]},
             {"messages": [{"role": "user", "content": [{"type": "text", "text": "Q"}]},
                           {"role": "assistant", "content": [{"type": "text", "text": "A"}]}]},
             [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}]]
    got = rows_by(format_chats(records(spark, items)), "conv_id")
    assert [said(got[i]) for i in range(len(items))] == [want] * len(items)
    assert [got[i]["layout"] for i in (0, 1, 3, 5, 7, 8)] == [
        "prompt_response", "prompt_completion", "instruction", "messages", "message_parts", "bare_messages"]
    more = [{"system": "S", "instruction": "Q", "input": "I", "output": "A"}, {"system": None, "prompt": None, "response": 5}]
    got = rows_by(format_chats(records(spark, more)), "conv_id")
    assert said(got[0]) == [("system", "S"), ("user", "Q\n\nI"), ("assistant", "A")]
    assert said(got[1]) == [("user", ""), ("assistant", "5")]


def test_defined_results_of_odd_records(spark):
    items = [None, "not json", '{"a":1,"a":2}', {"other": 1}, {"messages": []}, {"messages": [{"role": None, "content": None}]}, "3", "{}"]
    got = rows_by(format_chats(records(spark, items)), "conv_id")
    assert all(got[i]["layout"] is None and got[i]["turns"] is None and got[i]["formatted"] is None for i in (0, 1, 2, 3, 6, 7))
    assert got[3]["fingerprint"] == paths_fingerprint(["other"])
    assert said(got[4]) == [] and got[4]["formatted"] == ""
    assert said(got[5]) == [("", "")]
    assert format_chats(records(spark, []).where("false")).count() == 0
    # clashing extra columns, repeated rows
    df = records(spark, [{"prompt": "Q", "response": "A"}]).withColumn("layout", F.lit(1)).withColumn("turns", F.lit(2))
    assert format_chats(df.union(df)).count() == 2


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    chats = [[(rng.choice(["user", "assistant", "a\nb%0A", "<|im_start|>", "tool"]), rng.choice(ODD)) for _ in range(rng.randint(0, 6))]
             for _ in range(40)]
    df = records(spark, [{"messages": [{"role": r, "content": t} for r, t in c]} for c in chats])
    out = format_chats(df).select("conv_id", "formatted", "segments", parse_chat(F.col("formatted")).alias("turns"),
                                  learned_text(F.col("segments")).alias("learned"))
    for i, row in rows_by(out, "conv_id").items():
        assert said(row) == chats[i]
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
        assert row["learned"] == "".join(t for r, t in chats[i] if r == "assistant")
        texts = re.split(r"<\|im_(?:start|end)\|>", row["formatted"])
        assert len(texts) == 2 * len(chats[i]) + 1


def test_layouts_may_not_share_fields(spark):
    with pytest.raises(ValueError):
        select_layout(F.lit(""), LAYOUTS + (Layout("again", ("prompt", "response"), (Say("user", ("prompt",)),)),))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, 0, "user", "n"), (None, None, "assistant", None), (7, 0, None, "x")]
    for c in range(60):
        n = rng.randint(1, 5)
        roles = rng.choice([["user", "assistant"] * 3, ["system", "user", "assistant", "user", "assistant"], ["tool", "user", "human", "assistant", "x"]])
        rows += [(100 + c, t, roles[t], rng.choice(ODD)) for t in range(n)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    got = rows_by(op11_chat_format(spark, str(tmp_path)), "conv_id")
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, _, r, x in mine if r == "assistant")
        assert row["n_turns"] == len(mine) and row["loss_chars"] == len(learned)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in mine).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_query_uses_several_layouts_and_no_python(spark):
    from paraspark.llm.common import table
    chats = format_chats(conversation_records(table(spark, "/root/testdata/sf0.001", "conversations")))
    assert {r[0] for r in chats.select("layout").distinct().collect()} >= {"prompt_response", "messages", "conversations"}
    plan = op11_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
