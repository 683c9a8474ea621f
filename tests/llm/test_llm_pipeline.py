"""The pipeline's stages one after another, each against its operator's plain form."""

import corpus_pipeline
from llm_fixtures import docs, none, words
from test_llm_minhash import shingle_set

SMALL = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = spark.createDataFrame(stage(spark, table, SMALL).collect(), before.schema)
        assert table.columns == before.columns, name
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert {r["doc_id"] for r in table.select("doc_id").collect()} <= ids
        if name == "near dedup":
            sets = [shingle_set(r["text"], 5) for r in table.collect()]
            sets = [s for s in sets if s]
            for i, one in enumerate(sets):
                for other in sets[:i]:
                    assert 100 * len(one & other) < 80 * len(one | other)
    pieces = corpus_pipeline.pieces(spark, table, SMALL).collect()
    assert len(pieces) == table.count() and all(r["round_trip"] for r in pieces)


def test_run_and_clean_documents_stay(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r["round_trip"] for r in rows)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = {r["doc_id"] for r in documents.join(labels, "doc_id").where("length(text) > 200").collect()}
    kept = {r["doc_id"] for r in rows}
    assert len(clean & kept) > 0.8 * len(clean)


def test_awkward_and_empty_documents(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs(spark).select(columns), none(spark).select(columns)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SMALL)
        assert table.count() >= 0


def test_words_of_the_fixtures():
    assert words("A b\x0bC") == [b"a", b"b", b"c"]
