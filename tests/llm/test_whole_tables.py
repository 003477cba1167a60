"""What was lost at the edges of the training-data operators."""

import pytest

from pagesift.llm import packing, secrets, sharding


def test_end_of_a_secret_is_reported(spark):
    line = "password=Secret1!xyz9"
    base = secrets.base_spans(line)
    assert base and base[0][1] < len(line)
    (row,) = secrets.scan(spark.createDataFrame([(1, line)], "doc_id long, text string")).collect()
    assert {i for s in row.secrets for i in range(s.start, s.end)} >= set(range(len("password="), len(line)))
    assert [tuple(s) for s in base] == [(s.start, s.end, s.kind) for s in row.secrets if s.kind != "crf"]


@pytest.mark.parametrize("later", ["doc_id long, text string, more string", "doc_id string, text string", "doc_id long"])
def test_arrival_with_other_columns_is_refused(spark, tmp_path, later):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([], later))
    store.append(spark.createDataFrame([("b", 2)], "text string, doc_id long"))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "b")]


def test_packing_refuses_wide_ids(spark, monkeypatch):
    import sentencepiece

    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_piece_size", lambda self: 65536)
    packing.pack(df)
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_piece_size", lambda self: 65537)
    with pytest.raises(ValueError):
        packing.pack(df)
