"""Column functions against hand-worked rows and the written definitions."""

import re

from pyspark.sql import functions as F

from paraspark.functions import chat as C
from paraspark.functions.text import clean_prediction, flatten_text, normalize_text, title_case, token_count
from paraspark.functions.tokens import has_supervised, mask_labels

MSG = "array<struct<role:string,content:string>>"


def one(spark, expr, *cols, schema=None):
    df = spark.createDataFrame([cols], schema) if schema else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_normalize_and_flatten_follow_python_whitespace(spark):
    samples = ["  a b​c\x0b\x1c d 　", " x y\u0085", "", "   ", "AbC  É\n\n\tz"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select("t", normalize_text("t").alias("n"), flatten_text("t").alias("f"),
                     token_count("t").alias("k")).collect()
    for r in rows:
        assert r.n == re.sub(r"\s+", " ", r.t.lower().strip())
        assert r.f == " ".join(r.t.split())
        assert r.k == len(r.t.split())


def test_clean_prediction_cuts_at_earliest_marker(spark):
    assert one(spark, clean_prediction(F.lit(" hola<|endoftext|>x<|im_end|>"))) == "hola"
    assert one(spark, clean_prediction(F.lit("a<|im_start|>b"))) == "a"
    assert one(spark, clean_prediction(F.lit("  plain  "))) == "plain"


def test_title_case_matches_python(spark):
    for role in ["tool_use", "abc1def", "x"]:
        assert one(spark, title_case(F.lit(role))) == role.title()


def test_length_bucket_bounds(spark):
    df = spark.createDataFrame([(n,) for n in [0, 512, 513, 8192, 8193]], "n int")
    got = [r[0] for r in df.select(C.length_bucket("n")).collect()]
    assert got == ["0_512", "0_512", "512_1k", "6k_8k", "8k_plus"]


def test_infer_direction_rules(spark):
    rows = [
        ([("user", "Spanish: x English: y")], None, "es-en"),
        ([("user", "English: y")], "", "en-es"),
        ([("user", "nothing")], None, "unknown"),
        ([("user", "Spanish: x")], "en-es", "en-es"),
        ([], None, "unknown"),
    ]
    data = [([{"role": r, "content": c} for r, c in msgs], md) for msgs, md, _ in rows]
    df = spark.createDataFrame(data, f"messages {MSG}, md string")
    got = [r[0] for r in df.select(C.infer_direction("messages", F.col("md"))).collect()]
    assert got == [e for *_, e in rows]


def test_split_messages_and_renderings(spark):
    msgs = [{"role": "system", "content": "S"}, {"role": "user", "content": "U"}, {"role": "assistant", "content": "A"}]
    df = spark.createDataFrame([(msgs,)], f"messages {MSG}")
    r = df.select(C.format_texts("messages").alias("f"), C.render_prompt_only(C.prompt_messages("messages")).alias("p"),
                  F.size(C.prompt_messages("messages")).alias("n")).first()
    assert r.f.prompt == "System: S\nUser: U\nAssistant:"
    assert r.f.full_text == "System: S\nUser: U\nAssistant: A"
    assert r.f.reference == "A"
    assert r.p == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n"
    assert r.n == 2
    empty = spark.createDataFrame([([],)], f"messages {MSG}").select(C.format_texts("messages").alias("f")).first()
    assert (empty.f.prompt, empty.f.full_text, empty.f.reference) == ("Assistant:", "", "")


def test_source_text_markers(spark):
    msgs = [{"role": "user", "content": "a\nEnglish: b English: c"}]
    df = spark.createDataFrame([(msgs,), ([{"role": "system", "content": "x"}],)], f"messages {MSG}")
    got = [r[0] for r in df.select(C.source_text("messages")).collect()]
    assert got == ["b English: c", ""]


def test_label_mask_by_length(spark):
    df = spark.createDataFrame([([1, 2, 3], [7, 7, 7, 7, 7]), ([1, 2, 3, 4], [9])], "full array<int>, prompt array<int>")
    rows = df.select(mask_labels(F.col("full"), F.col("prompt")).alias("l")).select(
        "l", has_supervised(F.col("l")).alias("s")).collect()
    assert rows[0].l == [-100, -100, -100] and rows[0].s is False
    assert rows[1].l == [-100, 2, 3, 4] and rows[1].s is True


def test_chat_example_shape(spark):
    df = spark.createDataFrame([("t", "12", "formal", "hello", "hola", "es-en")],
                               "term string, target_length string, style string, english_scenario string, "
                               "spanish_translation string, direction string")
    ex = df.select(C.chat_example("direction").alias("e")).first().e
    assert [m.role for m in ex.messages] == ["system", "user", "assistant"]
    assert ex.messages[1].content == "Direction: Spanish to English\nStyle: formal\nTarget length: about 12 words\nSpanish: hola"
    assert ex.messages[2].content == "hello"
    assert ex.metadata.direction == "es-en"
