import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from skein.llm import langid, minhash, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{k}")
        out[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out[name].columns == columns
        before, docs = docs, out[name]
        if name == "quality classifier":
            good = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in good.select("doc_id").collect()}
        if name == "language ID":
            kept = langid.identify(before).filter(f"lang_pred != 'und' and score >= {langid.LEAST_SCORE}")
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
        if name == "MinHash near-dedup":
            kept = minhash.link_documents(before)[0].filter("kept")
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
        if name == "secret scans":
            assert docs.count() == before.count()
            assert secrets.scan_documents(docs).agg(F.sum("n_assign") + F.sum("n_access") + F.sum("n_hex")).first()[0] == 0
    packed = out["packing"].toPandas()
    whole = {k: np.sort(v["start"]) for k, v in packed.groupby("doc_id")}
    assert set(whole) == {r[0] for r in before.select("doc_id").collect()}
    assert (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
