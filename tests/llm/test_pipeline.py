import os

import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline_stages_add_up(spark):
    import corpus_pipeline as P

    from lodestone.plans.scratch import materialize

    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = docs.groupBy("doc_id").count().collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert ids["exact_dedup"] <= ids["language_id"] and ids["source_mixing"] <= ids["simhash_near_dedup"] <= ids["exact_dedup"]
    packed = P.STAGES[-1][1](spark, docs, SF)
    pieces = {r.doc_id: r["count"] for r in packed.where("piece = 0").groupBy("doc_id").count().collect()}
    assert pieces == {r.doc_id: r["count"] for r in kept["source_mixing"]}
    whole = P.run(spark, SF)
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(map(str, packed.drop("sequence_id", "offset").collect()))


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
