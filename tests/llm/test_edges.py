"""The pipeline and the store of shards at their edges."""

import pytest

from pagesift.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(1, "one two three four five six", "en", "a", 27), (1, "another text that shares the id", "en", "a", 31), (None, "one two three four five six", None, None, None), (None, None, None, None, None), (2, "", "de", "b", 0), (3, "x " * 30000, "de", "b", 60000), (3, "x " * 30000, "de", "b", 60000)]])
def test_pipeline_over_odd_documents(spark, tmp_path, rows):
    """Null and repeated ids, null, empty and long texts, repeated rows, and no rows at all: what comes out are rows of what came in."""
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in rows}


def test_classifier_stage_keeps_columns_and_scores_each_row(spark):
    from pagesift.llm.quality import accepted

    docs = spark.createDataFrame([(1, "good words here and there", 7, "k"), (None, None, 8, None), (1, "good words here and there", 9, "k")], "doc_id long, text string, stats int, __label string")
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 3)], "doc_id long, quality int")
    kept = accepted(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 3
    assert accepted(docs.limit(0), labels.limit(0)).count() == 0


def test_older_versions_of_a_store(spark, tmp_path):
    parts = [spark.createDataFrame([(i, "x" * 50)], "doc_id long, text string") for i in range(4)]
    store = sharding.shard_arrivals(parts, f"file://{tmp_path}/kept", history=True)
    assert [store.read(v).count() for v in (1, 2, 4)] == [1, 2, 4] and store.read().count() == 4
    assert len(store.shards()) < 4
    bare = sharding.shard_arrivals(parts, f"file://{tmp_path}/bare")
    assert bare.read().count() == 4


def test_near_stage_tells_rows_by_id_and_text(spark):
    """Texts that share an id: only the one that is a near copy goes, the other stays, and so do texts without words and null ids."""
    from pagesift.llm.near_dedup import representatives

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (7, base + " more"), (7, "an unrelated text with the same id as another"), (None, base + " less"), (9, None), (9, ""), (10, "x " * 50_000), (11, "x " * 50_000 + "y"), (None, "an unrelated text with the same id as another one")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, id int")
    kept = representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.id for r in kept.collect())) == [0, 2, 4, 5, 6, 7] and representatives(df.limit(0)).count() == 0
