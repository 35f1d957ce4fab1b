import corpus_pipeline
from runlens.llm import fmindex, near_dups
from tests.llm.conftest import SCHEMA

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "decontamination", "pieces"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns and out.count() <= n, name
        if name == "decontamination":
            assert out.count() == n
            before = {r.doc_id for r in fmindex.report(fmindex.find_hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))).where("contaminated").collect()}
            changed = {r.doc_id for r in out.alias("a").join(docs.select("doc_id", docs.text.alias("old")), "doc_id").where("text <> old").collect()}
            assert before == changed
        if name == "jaccard_join":
            from tests.llm.test_near_dups import brute

            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c, _ in brute(rows)})
            assert near_dups.classes(out).where("n_links > 0").isEmpty()
        docs, n = out, out.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == n and all(r.lossless for r in rows)


def test_empty_and_edge_tables(spark, edge, empty, tmp_path):
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count()
            docs = out if "text" in out.columns else docs
    assert SCHEMA
