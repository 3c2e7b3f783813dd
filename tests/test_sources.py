"""Read/write round trips."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from paraspark.sources import readers as IO
from paraspark.sources import writers as W


def test_csv_reader_handles_python_csv_dialect(spark, tmp_out):
    path = f"{tmp_out}/pairs.csv"
    rows = [{"term": "t1", "target_length": "0", "style": "formal", "english_scenario": 'say "hi"\nnow',
             "spanish_translation": "di hola"},
            {"term": "", "target_length": "3", "style": "brief", "english_scenario": "x", "spanish_translation": ""}]
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    df = IO.read_pairs(spark, path).orderBy("row_number").collect()
    assert [r.row_number for r in df] == [1, 2]
    assert df[0].english_scenario == 'say "hi"\nnow' and df[0].target_length == "0"
    assert df[1].term is None  # empty cell: missing either way


def test_jsonl_reader_truthiness_and_blank_lines(spark, tmp_out):
    path = f"{tmp_out}/pairs.jsonl"
    lines = [json.dumps({"term": "a", "target_length": 0, "style": "s", "english_scenario": "e", "spanish_translation": "x"}),
             "   ",
             json.dumps({"term": "b", "target_length": "0", "style": "s", "english_scenario": "e", "spanish_translation": []})]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    from paraspark.operators.validate import with_missing
    rows = with_missing(IO.read_pairs(spark, path)).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == [1, 2]
    assert rows[0].missing == ["target_length"]        # JSON 0 is missing
    assert rows[1].missing == ["spanish_translation"]  # "0" string is present, [] is missing


def test_jsonl_reader_fails_on_malformed_line(spark, tmp_out):
    path = f"{tmp_out}/bad.jsonl"
    with open(path, "w") as f:
        f.write('{"term": "a"}\n{not json\n')
    with pytest.raises(Exception):
        IO.read_pairs_jsonl(spark, path).collect()


def test_detect_format():
    assert IO.detect_format("x.CSV") == "csv" and IO.detect_format("y.Json") == "jsonl"
    with pytest.raises(ValueError):
        IO.detect_format("z.txt")


def test_chat_rewrite_keeps_unknown_keys(spark, tmp_out):
    src = f"{tmp_out}/chat.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"messages": [{"role": "user", "content": "English: hi"}], "extra": {"k": 1}}) + "\n\n")
        f.write(json.dumps({"messages": [], "segment_id": "s9"}) + "\n")
    chat = IO.read_chat(spark, src, require_messages=True)
    assert [r.line_no for r in chat.orderBy("line_no").collect()] == [1, 3]
    out = f"{tmp_out}/out"
    W.write_chat_jsonl(chat.orderBy("line_no"), out, added={"translation": F.lit("hola")})
    written = [json.loads(line) for p in sorted(glob.glob(out + "/part-*")) for line in open(p) if line.strip()]
    assert written[0]["extra"] == {"k": 1} and written[0]["translation"] == "hola"
    assert list(written[1]) == ["messages", "segment_id", "translation"]


def test_chat_reader_requires_messages(spark, tmp_out):
    src = f"{tmp_out}/nomsg.jsonl"
    with open(src, "w") as f:
        f.write('{"segment_id": "a"}\n')
    with pytest.raises(ValueError, match="line 1"):
        IO.read_chat(spark, src, require_messages=True)


def test_write_splits_keeps_empty_validation(spark, tmp_out):
    df = spark.createDataFrame([("a", "train")], "x string, split string")
    W.write_splits(df, f"{tmp_out}/splits")
    assert glob.glob(f"{tmp_out}/splits/split=validation")
    assert spark.read.json(f"{tmp_out}/splits").count() == 1


def test_quarantine_and_stats_keep_nulls(spark, tmp_out):
    df = spark.createDataFrame([("src", 3, "err", None)], "source string, row_number long, error string, meeting_id string")
    W.write_quarantine(df, f"{tmp_out}/q")
    lines = [json.loads(x) for p in glob.glob(f"{tmp_out}/q/part-*") for x in open(p) if x.strip()]
    line = lines[0]
    assert "meeting_id" in line and line["meeting_id"] is None


def test_text_lines_flattened(spark, tmp_out):
    df = spark.createDataFrame([("a\n b\tc ",)], "t string")
    W.write_text_lines(df, "t", f"{tmp_out}/txt")
    assert spark.read.text(f"{tmp_out}/txt").first().value == "a b c"


def test_cases_reader_defaults_and_direction(spark, tmp_out):
    path = f"{tmp_out}/cases.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["source_text", "direction", "prediction"])
        w.writerow(["hello", "", "hola"])
        w.writerow(["adios", "es-en", "bye"])
    rows = IO.read_cases(spark, path, direction="en-es").collect()
    assert len(rows) == 1 and rows[0].direction == "en-es" and rows[0].row_index == "0"
    assert rows[0].baseline_prediction == "hola" and rows[0].term == ""
    with pytest.raises(ValueError):
        IO.read_cases(spark, path, direction="both")


def test_csv_keeps_edge_spaces_and_writes_a_byte_order_mark(spark, tmp_out):
    rows = [(" lead", "trail ", "a,\"b\"\nc"), ("\t", " ", "é\U0001F600")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    W.write_table_csv(df, f"{tmp_out}/t.csv", bom=True)
    back = IO.read_csv_split(spark, f"{tmp_out}/t.csv")
    assert back.columns == ["a", "b", "c"]
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_added_keys_keep_nulls_and_replace_existing_ones(spark):
    lines = ['{"a":1}', '{}', '{"p":"old","z":[1,{"y":null}],"b":2}', '{"x":"}"}']
    df = spark.createDataFrame([(x, v) for x, v in zip(lines, ("new", None, None, "é"), strict=True)], "raw string, v string")
    got = [json.loads(r[0]) for r in df.select(W.with_added_keys("raw", p=F.col("v"))).collect()]
    assert got == [{"a": 1, "p": "new"}, {"p": None}, {"p": None, "z": [1, {"y": None}], "b": 2}, {"x": "}", "p": "é"}]
    assert list(got[2]) == ["p", "z", "b"]


def test_quarantine_keeps_the_whole_row_with_its_types(spark, tmp_out):
    from paraspark.plans.flows import run_prepare
    rows = [{"term": "t", "target_length": 12.0, "style": "s", "english_scenario": "e", "spanish_translation": "x", "extra": {"k": [1, None]}},
            {"term": "t", "target_length": 12.0, "style": "", "english_scenario": "e", "spanish_translation": "x", "extra": {"k": [1, None]}}]
    with open(f"{tmp_out}/in.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    assert IO.read_pairs_jsonl(spark, f"{tmp_out}/in.jsonl").first().target_length == "12.0"
    run_prepare(spark, f"{tmp_out}/out", input=f"{tmp_out}/in.jsonl", skip_invalid=True)
    line = next(x for p in glob.glob(f"{tmp_out}/out/skipped_rows/part-*") for x in open(p) if x.strip())
    record = json.loads(line)
    assert record["row"] == rows[1] and record["row_number"] == 2


def test_line_numbers_need_no_job_and_follow_files(spark, tmp_out):
    import os
    os.makedirs(f"{tmp_out}/many")
    for k in range(4):
        with open(f"{tmp_out}/many/part-{k}.txt", "w") as f:
            f.writelines(f"{k}-{i}\n" if i % 3 else "\n" for i in range(40 * (4 - k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        rows = IO.read_lines(spark, f"{tmp_out}/many").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{k}-{i}" if i % 3 else "" for k in range(4) for i in range(40 * (4 - k))]
    assert [r.value for r in rows] == want and [r.line_no for r in rows] == list(range(1, len(want) + 1))


def test_translate_and_training_flows(spark, tmp_out):
    from paraspark.operators.inference import upper_ascii_factory
    from paraspark.plans import flows
    lines = [{"messages": [{"role": "user", "content": f"hi {i}"}, {"role": "assistant", "content": f"ho {i}"}], "note": i} for i in range(5)]
    for name in ("train", "validation"):
        with open(f"{tmp_out}/{name}.jsonl", "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in lines)
    flows.run_translate(spark, f"{tmp_out}/train.jsonl", f"{tmp_out}/tr", upper_ascii_factory)
    out = [json.loads(x) for p in sorted(glob.glob(f"{tmp_out}/tr/translations/part-*")) for x in open(p) if x.strip()]
    assert [x["note"] for x in out] == list(range(5)) and all("HI" in x["translation"] for x in out)
    assert IO.read_csv_split(spark, f"{tmp_out}/tr/segments").count() == 5
    features = flows.run_training_data(spark, f"{tmp_out}/train.jsonl", f"{tmp_out}/validation.jsonl", f"{tmp_out}/feat", max_train=3)
    assert sorted((r.split, r.line_no) for r in features.collect()) == [("train", k) for k in (1, 2, 3)] + [("validation", k) for k in range(1, 6)]
    with open(f"{tmp_out}/empty.jsonl", "w") as f:
        f.write("\n")
    with pytest.raises(ValueError, match="validation"):
        flows.run_training_data(spark, f"{tmp_out}/train.jsonl", f"{tmp_out}/empty.jsonl", f"{tmp_out}/feat2")
