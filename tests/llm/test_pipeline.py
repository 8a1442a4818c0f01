"""The pipeline's stages, each on the whole of what the one before it kept."""

import corpus_pipeline
from tablewright.llm import toxicity
from tests.llm.fixtures import documents, long_line, prose, rows_of


def test_each_stage_takes_effect(spark, tmp_path):
    passage = prose(7000, 60, per_line=10**6)
    rows = [(k, prose(k, 80) + "\n" + (long_line(3) if k < 20 else "")) for k in range(1, 120)]
    rows += [(k, prose(k, 70) + "\nscumbag vermin trashfire\n") for k in range(200, 260)]
    rows += [(300, rows[40][1]), (301, rows[40][1]), (301, rows[40][1]), (302, None), (303, ""), (304, None)]
    rows += [(310 + k, f"Alone {k}.\n{prose(400 + k, 40)}\n{passage}\n{prose(500 + k, 40)}") for k in range(3)]
    rows += [(330, prose(600, 40)), (330, prose(601, 40))]
    docs = documents(spark, rows)
    docs = docs.toDF(*["more" if c == "TEXT" else c for c in docs.columns])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(200 <= k < 260)) for k in [*range(1, 120), *range(200, 260)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = seen[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert at.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    all_ids = sorted(i for i, _ in rows)
    left = ids(seen["toxicity"])
    assert not [i for i in left if 200 <= i < 260] and left == [i for i in all_ids if not 200 <= i < 260]
    lines = {r["doc_id"]: r for r in seen["line_dedup"].collect()}
    assert [i for i in range(1, 20) if long_line(3) in lines[i]["text"]] == [19] and ids(seen["line_dedup"]) == left
    near = ids(seen["near_dedup"])
    assert near == [i for i in left if i not in (300, 301)]
    assert near.count(330) == 2 and 302 in near and 304 in near
    cut = {r["doc_id"]: r["text"] for r in seen["substring_dedup"].collect()}
    assert passage in cut[310] and passage not in cut[311] and passage not in cut[312] and "Alone 2" in cut[312]
    assert ids(seen["substring_dedup"]) == near
    packed = seen["packing"]
    assert sorted({r["doc_id"] for r in packed.collect()}) == sorted(set(near))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert rows_of(again, "doc_id", "start", "length", "ids_crc32") == rows_of(packed, "doc_id", "start", "length", "ids_crc32")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), str(tmp_path)).collect() == []


def test_a_model_without_terms_rejects_nothing():
    assert toxicity.Model({}, -1.0, {}, []).scorer()("anything") < 0.5
