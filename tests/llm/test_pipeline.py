import random

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from paraspark.llm.sentencepiece_fst import MODEL_PATH
from tests.llm import test_mixing
from tests.llm.helpers import DOCS, docs, edge_texts, find_components, jaccard_linked, sentence, shingles
from tests.llm.test_quality import brute as counts


def corpus():
    rng = random.Random(12)
    common = sentence(rng, 400)
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(60, 120))) for _ in range(60)]
    texts += texts[:10] + [texts[3]] * 20
    texts += [f"{t} end{k}" for k, t in enumerate(texts[20:30])]
    texts += ["repeat these eight words again and again ok " * 10, "too short"] + [t for t in edge_texts() if not t or len(t) < 100]
    return [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]


def brute(rows):
    rows = [r for r in rows if not counts(r[1])[-1]]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    rows = [r for r in rows if r[0] == last[r[1]]]
    sets = {r[0]: shingles(r[1]) for r in rows}
    comps = find_components(list(sets), lambda a, b: jaccard_linked(sets[a], sets[b]))
    return [r for r in rows if comps[r[0]] == r[0]]


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    frame = spark.createDataFrame(rows, DOCS)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs_now = frame
    for _, stage in C.STAGES[:3]:
        docs_now = C.stored(stage(spark, docs_now, str(tmp_path)), "test-stage")
        assert docs_now.columns == frame.columns
    kept = brute(rows)
    assert sorted(r.doc_id for r in docs_now.collect()) == sorted(r[0] for r in kept)

    mixed = C.stored(C.mix(spark, docs_now, str(tmp_path)), "test-mix")
    assert mixed.columns == frame.columns
    rank = {r["doc_id"]: r["h"] for r in docs_now.select("doc_id", F.xxhash64(*docs_now.columns).alias("h")).collect()}
    want = test_mixing.brute([(rank[r[0]], r[1], r[3]) for r in kept])
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {r[0]: want[rank[r[0]]][3] // want[rank[r[0]]][0] for r in kept if want[rank[r[0]]][3]}

    public = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    result = C.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(result) == sum(times.values())
    assert all(r.ids == public.encode(texts[r.doc_id]) for r in result)


def test_stages_on_repeated_rows_null_ids_extra_columns_and_empty_tables(spark):
    text = " ".join(f"word{k}" for k in range(40))
    frame = docs(spark, [(1, text), (1, text), (None, text + " tail"), (None, None), (2, "short")])
    clash = frame.withColumn("kept", F.lit("x")).withColumn("row_hash", F.lit(1)).withColumn("times", F.lit(2)).withColumn("group", F.lit(3))
    good = C.keep_quality(spark, clash, "")
    assert good.columns == clash.columns and good.count() == 3
    single = C.keep_one_copy(spark, good, "")
    assert single.columns == clash.columns and sorted(str(r.doc_id) for r in single.collect()) == ["1", "None"]
    near = C.keep_one_near_copy(spark, single, "")
    assert near.columns == clash.columns and [r.doc_id for r in near.collect()] == [1]
    mixed = C.mix(spark, near, "")
    assert mixed.columns == clash.columns and {r.doc_id for r in mixed.collect()} <= {1}
    for name, stage in C.STAGES:
        assert stage(spark, docs(spark, []), "").count() == 0, name


def test_rows_that_differ_in_the_place_of_a_null_are_told_apart(spark):
    import corpus_pipeline
    rows, name = corpus_pipeline._numbered(spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string"))
    assert rows.select(name).distinct().count() == 2


def test_texts_go_to_the_last_stage_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "10000")
        C.encode(spark, docs(spark, ["some text"]), "")
        assert int(spark.conf.get(setting)) <= 1000
        spark.conf.set(setting, "10")       # a smaller one stays
        C.encode(spark, docs(spark, ["some text"]), "")
        assert spark.conf.get(setting) == "10"
    finally:
        spark.conf.set(setting, before)


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    import pyarrow as pa
    from paraspark.llm import common
    given = []

    class Pool:
        def release_unused(self):
            given.append("released")

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.record_batch([pa.array([1])], names=["x"])
    for found in common.trimmed(lambda batches: (b for b in batches))(iter([batch, batch])):
        given.append(found.num_rows)
    assert given == [1, 1, "released"]
