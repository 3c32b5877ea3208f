"""The pipeline's stages, each against what its operator decides about its own input."""

import corpus_pipeline
import __spark_entry__ as entry
from tests.oracle_check import connect, difference
from shopsight.llm import mixing, ngram_join, quality, queries, winnowing


def test_queries_as_sql(spark, sf_dir):
    for key in queries.oracle_sql():
        assert difference(spark, connect(sf_dir), sf_dir, key) is None


def test_names():
    found = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in found) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = [f for _, f in corpus_pipeline.STAGES]

    one = stages[0](spark, docs, sf_dir).cache()
    assert one.columns == docs.columns
    assert ids(one) == ids(quality.quality_scores(docs, marks).where("predicted = 1"))
    two = stages[1](spark, one, sf_dir).cache()
    assert two.columns == docs.columns
    assert ids(two) == sorted({r.component_id for r in ngram_join.near_duplicates(one).collect()})
    three = stages[2](spark, two, sf_dir).cache()
    assert three.columns == docs.columns
    assert ids(three) == ids(winnowing.contamination(two, items).where("NOT contaminated"))
    four = stages[3](spark, three, sf_dir).cache()
    assert four.columns == docs.columns
    want = [r.doc_id for r in mixing.mix_documents(three).collect() for _ in range(r.taken // r.size if r.size else 0)]
    assert ids(four) == sorted(want)
    assert ids(stages[4](spark, four, sf_dir)) == sorted(want)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
