"""End-to-end flows on small files written by the tests."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from paraspark.operators import compare as J
from paraspark.operators import validate as V
from paraspark.operators.inference import upper_ascii_factory
from paraspark.plans import flows
from paraspark.sources.routed import write_routed


def _pairs_jsonl(path, n=12):
    with open(path, "w") as f:
        for i in range(n):
            row = {"term": f"t{i}", "target_length": 10 + i, "style": "formal" if i % 5 else "",
                   "english_scenario": f"English text {i}", "spanish_translation": f"texto {i}"}
            f.write(json.dumps(row) + "\n")


def _lines(folder):
    return [json.loads(x) for p in glob.glob(folder + "/**/part-*", recursive=True) for x in open(p) if x.strip()]


def test_prepare_then_reweight_then_calibrate(spark, tmp_out):
    src = f"{tmp_out}/pairs.jsonl"
    _pairs_jsonl(src)
    stats = flows.run_prepare(spark, f"{tmp_out}/prep", input=src, skip_invalid=True, bidirectional=True,
                              validation_ratio=0.3).first()
    assert stats.source_rows == 12 and stats.skipped == 3 and stats.total == 18
    assert len(_lines(f"{tmp_out}/prep/skipped_rows")) == 3
    ex = _lines(f"{tmp_out}/prep/examples")
    assert len(ex) == 18 and {m["role"] for e in ex for m in e["messages"]} == {"system", "user", "assistant"}

    train = f"{tmp_out}/train.jsonl"
    val = f"{tmp_out}/validation.jsonl"
    with open(train, "w") as f:
        for e in ex[:10]:
            f.write(json.dumps(e) + "\n")
    with open(val, "w") as f:
        for e in ex[10:]:
            f.write(json.dumps(e) + "\n")
    report = {(r.split, r.direction): r for r in flows.run_reweight(spark, train, val, f"{tmp_out}/rw").collect()}
    out_train = _lines(f"{tmp_out}/rw/train")
    n_en = sum(1 for e in ex[:10] if e["metadata"]["direction"] == "en-es")
    assert len(out_train) == 2 * n_en + (10 - n_en)
    assert report[("train", "en-es")].output_count == 2 * n_en

    frame = flows.run_calibrate(spark, train, f"{tmp_out}/cal", sample_size=4)
    recs = _lines(f"{tmp_out}/cal/calibration_prompt_only")
    assert len(recs) == 4 and all(r["mode"] == "prompt_only" and r["meeting_id"] is None for r in recs)
    assert sorted(r["id"] for r in recs) == ["1_prompt_only", "2_prompt_only", "3_prompt_only", "4_prompt_only"]
    st = _lines(f"{tmp_out}/cal/stats")[0]
    assert st["sample_size_written"] == 4 and sum(st["direction_counts"].values()) == 4


def test_evaluate_from_test_file(spark, tmp_out):
    import csv
    path = f"{tmp_out}/test.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["term", "target_length", "style", "english_scenario", "spanish_translation"])
        for i in range(6):
            w.writerow([f"t{i}", "5", "formal", f"hello {i}", f"HELLO {i}"])
    summary = {r.level + str(r.direction): r for r in
               flows.run_evaluate(spark, f"{tmp_out}/ev", upper_ascii_factory, test_file=path, sample_size=4).collect()}
    assert summary["overallNone"].num_examples == 8
    files = sorted(glob.glob(f"{tmp_out}/ev/predictions/part-*.csv"))
    assert files and all(open(p).readline().strip().split(",") == list(flows.PREDICTION_COLUMNS) for p in files)


def test_streaming_prepare(spark, tmp_out):
    import os
    from paraspark.streaming import prepare_stream
    os.makedirs(f"{tmp_out}/in")
    _pairs_jsonl(f"{tmp_out}/in/a.jsonl", 5)
    q = prepare_stream(spark, f"{tmp_out}/in", f"{tmp_out}/out", f"{tmp_out}/ckpt")
    q.awaitTermination(120)
    assert len(_lines(f"{tmp_out}/out/examples")) == 2 * 4
    assert len(_lines(f"{tmp_out}/out/skipped_rows")) == 1


def test_prepare_scans_once_commits_together_and_writes_its_report(spark, tmp_out):
    src = f"{tmp_out}/pairs.jsonl"
    _pairs_jsonl(src)
    stats = flows.run_prepare(spark, f"{tmp_out}/p", input=src, skip_invalid=True, validation_ratio=0.3).first()
    doc = _lines(f"{tmp_out}/p/stats")[0]
    assert list(doc) == ["sources", "train_path", "validation_path", "total", "source_rows", "train", "validation", "skipped",
                         "validation_ratio", "seed", "bidirectional", "train_all", "skip_invalid", "skipped_rows_path"]
    assert doc["sources"] == [src] and doc["total"] == stats.total == doc["train"] + doc["validation"] == 9
    assert len(_lines(doc["train_path"])) == doc["train"] and len(_lines(doc["validation_path"])) == doc["validation"]
    assert all(set(r) == {"source", "row_number", "error", "row"} for r in _lines(doc["skipped_rows_path"]))

    # train-all: an empty validation folder; a strict run over a bad row names it and leaves nothing
    good = f"{tmp_out}/good.jsonl"
    with open(src) as f, open(good, "w") as g:
        g.writelines(line for line in f if json.loads(line).get("spanish_translation") and json.loads(line).get("style")
                     and json.loads(line).get("term") and json.loads(line).get("english_scenario") and json.loads(line).get("target_length"))
    flows.run_prepare(spark, f"{tmp_out}/all", input=good, train_all=True)
    assert _lines(f"{tmp_out}/all/examples/split=validation") == [] and os.path.isdir(f"{tmp_out}/all/examples/split=validation")
    assert _lines(f"{tmp_out}/all/stats")[0]["skipped_rows_path"] is None
    with pytest.raises(ValueError, match="missing required fields"):
        flows.run_prepare(spark, f"{tmp_out}/strict", input=src)
    assert not any(files for _, _, files in os.walk(f"{tmp_out}/strict"))
    with pytest.raises(Exception, match="already"):
        flows.run_prepare(spark, f"{tmp_out}/all", input=good, train_all=True)


def test_report_documents_of_reweight_and_evaluate(spark, tmp_out):
    rows = [{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}], "metadata": {"direction": d}}
            for d in ["en-es"] * 3 + ["es-en"]]
    for name in ("train", "validation"):
        with open(f"{tmp_out}/{name}.jsonl", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
    flows.run_reweight(spark, f"{tmp_out}/train.jsonl", f"{tmp_out}/validation.jsonl", f"{tmp_out}/rw", seed=5)
    doc = _lines(f"{tmp_out}/rw/stats")[0]
    assert doc["repeats"] == {"en-es": 2, "es-en": 1} and doc["seed"] == 5 and doc["shuffled"] is True
    assert doc["train"] == {"input_total": 4, "input_direction_counts": {"en-es": 3, "es-en": 1},
                            "input_direction_ratio": {"en-es": 0.75, "es-en": 0.25}, "output_total": 7,
                            "output_direction_counts": {"en-es": 6, "es-en": 1},
                            "output_direction_ratio": {"en-es": 0.8571, "es-en": 0.1429}}
    assert doc["validation"]["output_direction_counts"] == {"en-es": 3, "es-en": 1}

    with open(f"{tmp_out}/cases.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["direction", "source_text", "reference_text"])
        w.writerows([["es-en", f"s {k}", "" if k % 2 else f"S {k}"] for k in range(6)] + [["en-es", "t", ""]])
    flows.run_evaluate(spark, f"{tmp_out}/ev", upper_ascii_factory, cases_file=f"{tmp_out}/cases.csv")
    doc = _lines(f"{tmp_out}/ev/summary")[0]
    assert (doc["num_examples"], doc["num_scored_examples"], list(doc)[-2:]) == (7, 3, ["en-es", "es-en"])
    assert set(doc["en-es"]) == {"num_examples", "num_scored_examples"} and "exact_match" in doc["es-en"]
    (part,) = glob.glob(f"{tmp_out}/ev/predictions/part-*.csv")
    with open(part, newline="") as f:
        assert [r["source_text"] for r in csv.DictReader(f)] == [f"s {k}" for k in range(6)] + ["t"]


def test_routed_sink_leaves_nothing_of_a_failed_job(spark, tmp_out):
    lines = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("route"), F.col("id").cast("string").alias("line"))
    write_routed(lines.repartition(4), f"{tmp_out}/out", ["a", "b", "c/d"])
    read = {r: sorted(int(x) for p in glob.glob(f"{tmp_out}/out/{r}/*") for x in open(p)) for r in ("a", "b", "c/d")}
    assert read["a"] == list(range(0, 1000, 3)) and len(read["b"]) == 666 and read["c/d"] == []
    assert sorted(os.listdir(f"{tmp_out}/out")) == ["a", "b", "c"]
    bad = lines.withColumn("line", F.when(F.col("line") == "997", F.raise_error(F.lit("late"))).otherwise(F.col("line")))
    for frame, routes in ((bad, ["a", "b"]), (lines, ["a"])):
        with pytest.raises(Exception):
            write_routed(frame.repartition(3), f"{tmp_out}/bad", routes)
        assert not any(files for _, _, files in os.walk(f"{tmp_out}/bad"))
    write_routed(lines.limit(1), f"{tmp_out}/out", ["a", "b"], mode="overwrite")
    assert [open(p).read() for p in glob.glob(f"{tmp_out}/out/a/*")] in (["0\n"], [""])


def test_translation_files_and_training_without_validation(spark, tmp_out):
    rows = [{"messages": [{"role": "user", "content": "English: hi"}, {"role": "assistant", "content": "hola"}], "segment_id": None, "other": 1},
            {"messages": [{"role": "user", "content": "English: bye"}], "accent": "north"}]
    with open(f"{tmp_out}/in.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    flows.run_translate(spark, f"{tmp_out}/in.jsonl", f"{tmp_out}/tr", upper_ascii_factory)
    out = _lines(f"{tmp_out}/tr/translations")
    assert [list(r) for r in out] == [["messages", "segment_id", "other", "translation"], ["messages", "accent", "translation"]]
    assert "HOLA" in out[0]["translation"]      # all messages are the prompt
    (part,) = glob.glob(f"{tmp_out}/tr/segments/part-*.csv")
    with open(part, newline="", encoding="utf-8-sig") as f:
        table = list(csv.DictReader(f))
    assert list(table[0]) == ["segment_id", "accent", "youtube_id", "start_time", "duration", "source_text", "translation"]
    assert [(r["segment_id"], r["accent"], r["source_text"]) for r in table] == [("", "", "hi"), ("2", "north", "bye")]
    got = flows.run_training_data(spark, f"{tmp_out}/in.jsonl", None, f"{tmp_out}/feat")
    assert {r.split for r in got.collect()} == {"train"}


def test_caps_by_order_statistics(spark):
    keys = [(s, k * 7919 % 10_007 - 5000) for s, m in (("train", 3000), ("validation", 40), (None, 5)) for k in range(m)]
    df = spark.createDataFrame(keys, "split string, k long")
    for n in (0, 1, 39, 40, 41, 2999, 5000):
        out = V.take_first(df, n, "k")
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        got = {s: sorted(r.k for r in out.collect() if r.split == s) for s in ("train", "validation", None)}
        assert got == {s: sorted(k for t, k in keys if t == s)[:n] for s in got}
    huge = spark.createDataFrame([(-2 ** 63,), (0,), (2 ** 63 - 1,)], "k long")
    assert sorted(r.k for r in V.take_first(huge, 2, "k", by=None).collect()) == [-2 ** 63, 0]
    ties = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None)], "split string, k long")
    assert [V.take_first(ties, n, "k").count() for n in (1, 2, 3, 9)] == [1, 2, 3, 4]


def test_cases_of_an_earlier_run_in_their_order(spark):
    cases = spark.createDataFrame([("b", "x", 0), ("a", "x", 1), ("c", "x", 2), ("b", "x", 3)], "row_index string, direction string, case_index long")
    run = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("z", "x", 3.0)], "row_index string, direction string, chrf_like double")
    got = J.same_cases(run, cases, ["row_index", "direction"], index="case_index").collect()
    assert [(r.row_index, r.case_index) for r in got] == [("b", 0), ("a", 1)]
